import random

import numpy as np
import pytest

from gaitframe.llm import decontaminate as D


def words_of(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return D.symbols(data, np.array([0, len(data)]))[0].tolist()


def distance(item, region):
    """Smallest edit distance of the item to any passage of the region."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item):
        step = [i + 1]
        for j, y in enumerate(region):
            step.append(min(row[j + 1] + 1, row[j] + (x != y), step[j] + 1))
        row = step
    return min(row)


def edited(rng, tokens, edits):
    tokens = list(tokens)
    for _ in range(edits):
        i = rng.randrange(len(tokens))
        kind = rng.random()
        if kind < 0.4:
            tokens[i] = f"new{rng.randrange(9999)}"
        elif kind < 0.7:
            tokens.insert(i, f"ins{rng.randrange(9999)}")
        else:
            del tokens[i]
    return tokens


@pytest.fixture(scope="module")
def world():
    rng = random.Random(5)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(60)]
    items += [(100, "tiny passage here"), (101, None), (102, ""), (103, "five words are in this")]
    docs = []
    for d in range(400):
        tokens = [word() for _ in range(rng.randint(0, 250))]
        if d % 2:
            item = rng.choice(items[:60])[1].split()
            at = rng.randint(0, len(tokens))
            tokens[at:at] = edited(rng, item, rng.randint(0, int(0.28 * len(item))))
        text = "\n".join(" ".join(tokens[i:i + 13]) for i in range(0, len(tokens), 13))
        docs.append((d, text.title() if d % 7 == 0 else text.replace(" w1", ", w1")))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (903, "Tiny, passage here!"), (904, (items[5][1] + "\n") * 3000)]
    return docs, items


def test_finds_what_brute_force_finds(spark, world):
    docs, items = world
    want = {}
    grams = {i: words_of(t) for i, t in items if t}
    for d, text in docs[:-1]:
        region = words_of(text)
        for i, item in grams.items():
            dist = distance(item, region)
            if dist <= int(0.2 * len(item) + 1e-9):
                want[d, i] = dist
    got_rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in got_rows if r.doc_id != 904}
    assert set(got) <= set(want)
    assert len(got) >= 0.98 * len(want) and len(want) > 100
    assert all(got[k] >= want[k] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
    assert (903, 100) in got and (902, 3) in got
    assert [r.item_id for r in got_rows if r.doc_id == 904] == [5]
    spans = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in got_rows}
    for (d, i), (a, b) in list(spans.items())[:60]:
        region = words_of(dict(docs)[d])[a:b + 1]
        assert distance(grams[i], region) == {**got, (904, 5): 0}[d, i]


def test_portions_give_the_same(spark, world):
    docs, items = world
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(d, b).collect()))
    assert sorted(map(tuple, D.contaminated(d, b, portion_bytes=4000).collect())) == one


def test_drop(spark, world):
    docs, items = world
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("distance", D.F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    gone = {r.doc_id for r in D.contaminated(d, b).collect()}
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(x for x, _ in docs if x not in gone)


def test_empty(spark):
    d, b = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "some words in a text")], "doc_id long, text string")
    assert D.contaminated(d, b).count() == 0 and D.contaminated(some, b).count() == 0
    assert D.contaminated(d, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_all_outer_marks_are_dropped(spark):
    item = [f"k{i}" for i in range(10)]
    dotted = " ".join(w + "...." if i in (1, 4, 6, 8) else '(("' + w if i == 2 else w for i, w in enumerate(item))
    assert words_of(dotted) == words_of(" ".join(item)) and len(words_of(".... -- x")) == 3 and words_of("....") == words_of(". ") != words_of("-")
    docs = spark.createDataFrame([(1, f"some words before {dotted} and after"), (2, "... .... ....... " * 40)], "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(1, 5, 0)]
