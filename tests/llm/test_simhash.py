import random
import re

import numpy as np
import pytest
import xxhash

from gaitframe.llm import simhash


def brute_fingerprint(text, k=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(tokens[i:i + k]) for i in range(max(1, len(tokens) - k + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, bits=4):
    parent = dict.fromkeys(ids)
    for i in parent:
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ x) <= bits)
        for j in near:
            a, b = sorted((root(ids[i]), root(ids[i + 1 + j])))
            parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t ", "One", "a b c", "A b\tc\nd", "É a b É c É d e f g", "x " * 70000])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text)[0] & (1 << 64) - 1 == brute_fingerprint(text)


def test_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('a b c d') h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c d", 42)


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("run", [4096, 40])
def test_links_lose_nothing(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(400)} | {flipped(rng, centre, rng.randint(0, 6)) for _ in range(300)}
    fps |= {flipped(rng, f, rng.randint(1, 5)) for f in list(fps)[:300]}
    values = np.array(sorted(fps), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "f0 long")
    links = [(r.a0 & (1 << 64) - 1, r.b0 & (1 << 64) - 1) for r in simhash.fingerprint_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = brute_components([int(v) for v in values], values)
    from gaitframe.llm.components import connected_components
    rank = {int(v): i for i, v in enumerate(values)}
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame([(rank[a], rank[b]) for a, b in links], "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in range(len(values))} == {rank[k]: rank[v] for k, v in want.items()}


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "one two"), (9004, "One  two"), (None, "other words here now")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra).withColumn("fp", simhash.F.lit("clash")).withColumn("component", simhash.F.lit(1))
    rows = both.collect()
    fps = np.array([brute_fingerprint(r.text) for r in rows], np.uint64)
    want = brute_components([r.doc_id if r.doc_id is not None else 10 ** 9 for r in rows], fps)
    got = simhash.near_duplicates(both).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {k: v for k, v in want.items() if k != 10 ** 9}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0


def test_similar_documents_are_linked(spark):
    """Pairs of five-word similarity from 0.85 are found, unrelated texts are left alone."""
    rng = random.Random(2)
    rows, edited = [], []
    for d in range(300):
        tokens = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(120, 400))]
        rows.append((d, " ".join(tokens)))
        for _ in range(int(len(tokens) * 0.012)):
            tokens[rng.randrange(len(tokens))] = "changed"
        edited.append((1000 + d, " ".join(tokens)))
    frame = spark.createDataFrame(rows + edited, "doc_id long, text string")
    part = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, **simhash.SIMILAR).collect()}

    def similarity(a, b):
        a, b = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    close = [d for d in range(300) if similarity(rows[d][1], edited[d][1]) >= 0.85]
    assert len(close) > 150
    assert sum(part[d] == part[1000 + d] for d in close) >= 0.95 * len(close)
    assert all(part[d] == d for d in range(300))


def _shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))) if t else frozenset()


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _edited(rng, tokens, share):
    """Tokens with a run of new words at the end, for a shingle similarity of about ``share``."""
    n = round((len(tokens) - 4) * (1 - share) / (1 + share))
    return tokens[:len(tokens) - n] + [f"n{rng.randrange(10 ** 6)}" for _ in range(n)]


def test_links_are_the_pairs_of_the_similarity(spark):
    """Just above 0.8 pairs are linked, just below they are not: both were decided by distance before."""
    rng, rows, want = random.Random(5), [], {}
    for d in range(900):
        tokens = [f"w{rng.randrange(50_000)}" for _ in range(rng.randint(104, 400))]
        other = _edited(rng, tokens, (0.82, 0.77, 0.7)[d % 3])
        rows += [(d, " ".join(tokens)), (1000 + d, " ".join(other))]
        want[d] = _jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    part = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, **simhash.SIMILAR).collect()}
    assert sum(want.values()) > 250 and not any(part[1000 + d] == d for d in want if not want[d])
    assert sum(part[1000 + d] == d for d in want if want[d]) >= 0.99 * sum(want.values())
    kept = {r.doc_id for r in simhash.keep_first(frame, **simhash.SIMILAR).collect()}
    assert {1000 + d for d in want if not want[d]} <= kept


def test_band_recall_at_the_limit():
    """Recall of the only step that can miss a pair, on sets of similarity 0.8 exactly: 0.9996 by the formula."""
    from gaitframe.llm import similar
    rng, found = np.random.default_rng(9), 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 64, 180, dtype=np.uint64)
        a, b = np.unique(h[:162]), np.unique(np.concatenate([h[:144], h[162:]]))
        assert len(np.intersect1d(a, b)) == 0.8 * len(np.union1d(a, b))
        found += any(x == y for x, y in zip(similar.bands(a), similar.bands(b), strict=True))
    assert found >= 1994


def test_near_copies_connect_like_all_pairs(spark):
    """One large group of near copies, some of whose pairs are below the similarity, and cases of the contract."""
    rng = random.Random(8)
    tokens = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(250):
        some = list(tokens)
        for _ in range(rng.randint(0, 6)):
            some[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(some))
    repeated = "same words in a row " * 200
    texts += [None, "", " \t", "one two", "One  Two", repeated, repeated + " ".join(f"q{i}" for i in range(40)), texts[0].upper()]
    rows = list(enumerate(texts)) + [(None, texts[3])]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [_shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a | sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: root(i) for i in range(len(texts))}
    assert len({root(i) for i in range(250)}) > 1


@pytest.mark.parametrize("run", [2048, 60])
def test_few_pairs_are_read_and_parts_are_those_of_all_pairs(spark, monkeypatch, run):
    """500 near copies, 500 texts with the same 200 words of boilerplate (similarity about 0.5), 500 others."""
    from gaitframe.llm import similar
    monkeypatch.setattr(similar, "RUN", run)
    rng = random.Random(31)
    base, boilerplate = [f"b{i}" for i in range(150)], [f"c{i}" for i in range(200)]
    texts = []
    for _ in range(500):
        some = list(base)
        for _ in range(rng.randint(0, 5)):
            some[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(some)
    texts += [boilerplate + [f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randint(60, 120))] for _ in range(500)]
    texts += [[f"z{rng.randrange(10 ** 6)}" for _ in range(rng.randint(60, 300))] for _ in range(500)]
    verified, read = similar._verified, []

    def counted(pairs, sets_of, similarity):
        read.append(pairs.count())
        return verified(pairs, sets_of, similarity)

    monkeypatch.setattr(similar, "_verified", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.SIMILAR).collect()}
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i - i % 500, i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert [got[i] for i in range(len(rows))] == root
    assert sum(read) < 20_000 and len(set(root[:500])) < 500


def test_counts_in_common_and_their_bound():
    from gaitframe.llm import similar
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 5000, n)) for n in (0, 1, 300, 4000, 4000, 900)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = similar.common_counts(sets)
    assert all(want[i][j] is None or got[i, j] == want[i][j] for i in range(6) for j in range(6))
    wide = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (0, 10, 500)] + [np.arange(10, dtype=np.uint64)]
    counts = [np.frombuffer(similar.strata(s), "<u2").astype(int) for s in wide]
    assert all(c.sum() == len(s) for c, s in zip(counts, wide, strict=True))
    full = np.frombuffer(similar.strata(np.arange(70_000, dtype=np.uint64)), "<u2")
    assert (full == 65535).all()


def test_pipeline_links_by_fingerprint_and_by_similarity(spark):
    """Equal fingerprints of unlike sets, like sets of unlike fingerprints, and a group that needs both links."""
    import corpus_pipeline

    rng = random.Random(31)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    run = ["tick"] * 200
    one, two = words(8), words(8)
    base = words(160)
    texts = {1: run + one, 2: run + two, 3: base, 4: [*base[:159], "other"], 5: words(90), 6: words(90), 7: None, 8: ""}
    third = run + two[:4] + words(1) + two[5:]
    rows = [(d, " ".join(t) if t else t, "en", "s", 0) for d, t in {**texts, 9: third}.items()] + [(None, "tick", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    part = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, **simhash.SIMILAR).collect()}
    assert part[2] == 2 and part[4] == 3
    kept = sorted(r.doc_id or 0 for r in corpus_pipeline.simhash_dedup(spark, frame, "").collect())
    assert kept == [0, 1, 3, 5, 6, 7]
