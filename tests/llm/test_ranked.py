import math
import random
import re
from collections import Counter

import numpy as np

from gaitframe.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs if terms(text)]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scored = []
        for doc_id, tf, size in held:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(c * w[t] * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in asked.items() if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, query string")
    return sorted((tuple(r) for r in ranked.rank_documents(d, q, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 5, 40, 400])))) for i in range(n)], rng, words, weight


def test_equals_brute_force(spark, monkeypatch):
    docs, rng, words, weight = corpus(1, 700)
    docs += [(None, "w1 w5 w200"), (3, "w1 w5 w200"), (3, "w1 w5 w200"), (9000, None), (9001, ""), (9002, " .,- \n"), (9003, "É Wörter W1, ñandú! " * 50),
             (9004, "w0 " * 30000)]
    items = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 2, 9, 30])))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "absent"), (103, "w1 w1 W1 wörter ñANDÚ"), (103, "w2"), (104, "w7"), (104, "w7"), (None, "w9 w10 w11")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(ranked, "GROUP", 320)
    monkeypatch.setattr(ranked, "PORTION", 7)
    assert found(spark, docs, items) == want


def test_ties_by_id(spark):
    docs = [(i, "alpha beta") for i in range(50, 0, -1)] + [(i, "gamma") for i in range(100, 200)]
    assert [r[2] for r in sorted(found(spark, docs, [(1, "alpha")]), key=lambda r: r[1])] == list(range(1, 21))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_joint_maxima_tighten_the_bound_and_lists_are_skipped():
    """Heavy terms that never meet: the pair bound stops new documents where the sum of the single maxima would not."""
    import pyarrow as pa
    n = 4000
    rows = [{"id": i, "m": 100, "terms": [1 if i % 2 else 2, 3], "often": [1 + (i < 40) * 5, 1]} for i in range(n)]
    schema = pa.schema([("id", pa.int64()), ("m", pa.int64()), ("terms", pa.list_(pa.int64())), ("often", pa.list_(pa.int32()))])
    lists = ranked.Lists([pa.RecordBatch.from_pylist(rows, schema)])
    asked = [(3, 900), (1, 100), (2, 100), (4, 1)]
    plain = lists.best(asked, 20)
    lists.meet(asked[0], asked[1], 20)
    lists.meet(asked[2], asked[3], 20)
    top, tight = max(int(lists.of(t, w)[1].max(initial=0)) for t, w in asked[1:3]), lists.pairs[asked[2], asked[3]]
    assert tight == (0, 0) and lists.pairs[asked[0], asked[1]][1] > 0 and top > 0
    assert all((a == b).all() for a, b in zip(plain, lists.best(asked, 20), strict=True))
    disjoint = [(1, 100), (2, 100)]
    lists.meet(*disjoint, 20)
    singles = sum(int(lists.of(*t)[1].max()) for t in disjoint)
    assert lists.pairs[tuple(disjoint)][0] == 0 < singles
    assert not lists.total.any()
    assert np.array_equal(lists.best(disjoint, 3)[0], [0, 1, 2])
