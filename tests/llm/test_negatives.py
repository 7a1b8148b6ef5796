import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, key string, `rank` int"


def brute(rows, scale=256, positives=5, take=10, low=30, high=90):
    kept = []
    for vec_id, label, v, *_ in rows:
        if vec_id is None or label is None or v is None or any(e is None or not np.isfinite(e) for e in v):
            continue
        kept.append((vec_id, label, [int(np.floor(np.float64(np.float32(e)) * scale)) for e in v]))
    out = []
    for a, label, x in kept:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, other, y in kept if b != a and len(y) == len(x))
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(b, -s) for s, b, other in scored if other != label and low * -minus <= 100 * -s <= high * -minus][:take]
            out += [(a, p, r + 1, b, -minus, s) for r, (b, s) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_equals_brute_force_with_null_long_tied_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "RUN", 128)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = centres[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.5])
        rows.append((i, int(i % 4), [float(e) for e in v], "x", 1))
    common = rows[7][2]
    rows += [(1000 + i, i % 2, common, "same", 2) for i in range(300)]
    rows += [(5000, 1, [1.0, None] + [0.0] * 6, None, 1), (5100, 1, None, None, 1), (5200, None, common, None, 1), (None, 1, common, None, 1),
             (5300, 1, [float("nan")] * 8, None, 1), (5400, 1, [float("inf")] * 8, None, 1), (5500, 2, [0.0] * 8, None, 1), (5600, 1, [], None, 1),
             (5601, 1, [], None, 1), (5602, 2, [], None, 1), (5700, 1, [1.0, 2.0], None, 1), (5701, 1, [1.0, 1.0], None, 1), (5702, 3, [1.0, 0.5], None, 1)]
    assert mined(spark, rows) == brute(rows)
    again = [r for r in rows if r[0] in (101, 102, 103)]
    assert mined(spark, rows + again) == brute(rows + again)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(np.float32(e)) for e in rng.normal(size=4) * 2.0 ** 22], "", 0) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_tree_covers_its_rows_and_search_skips_far_nodes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 6)) * 20 + c for c in rng.normal(size=(8, 6)) * 400]).astype(np.int64)
    tree = negatives.cover_tree(1, np.arange(len(x)), x)
    assert sorted(tree.ids.tolist()) == list(range(len(x)))
    assert (x[tree.ids] == tree.rows).all()
    long = np.concatenate([tree.rows, np.sqrt(np.maximum(tree.longest ** 2 - (tree.rows ** 2).sum(axis=1), 0))[:, None]], axis=1) / tree.longest
    leaves = tree.nodes[tree.nodes[:, negatives._LEAF] == 1]
    assert leaves[0, 2] == 0 and leaves[-1, 3] == len(x) and (leaves[1:, 2] == leaves[:-1, 3]).all()
    for number, node in enumerate(tree.nodes):
        below = [number]
        for child in range(number + 1, len(tree.nodes)):
            if tree.nodes[child, negatives._PARENT] in below:
                below.append(child)
        for leaf in below:
            if tree.nodes[leaf, negatives._LEAF]:
                rows = long[tree.nodes[leaf, 2]:tree.nodes[leaf, 3]]
                assert np.arccos(np.clip(rows @ long[node[negatives._CENTRE]], -1, 1)).max() <= tree.angle[number] + 1e-6
    visited = []
    products = negatives._products
    try:
        negatives._products = lambda x, q, s, t, a, b: visited.append(b - a) or products(x, q, s, t, a, b)
        a = negatives.Anchors(np.zeros(1, np.int64), np.array([-1]), np.array([1]), x[:1], np.array([[-(1 << 62)]]), np.array([[1 << 62]]))
        best = negatives.search([tree], a, 5, True)
    finally:
        negatives._products = products
    assert sum(visited) < len(x) / 2
    scores = x @ x[0]
    want = sorted(((-s, i) for i, s in enumerate(scores.tolist())))[:5]
    assert [(-s, i) for _, s, i in best.at[0].tolist()] == want


@pytest.mark.parametrize("groups", [1, 5])
def test_groups_do_not_change_the_result(spark, monkeypatch, groups):
    rng = np.random.default_rng(9)
    rows = [(i, i % 5, [float(e) for e in rng.normal(size=6)], "", 0) for i in range(600)]
    monkeypatch.setattr(negatives, "RUN", 64)
    monkeypatch.setattr(negatives, "GROUP", 600 // groups)
    assert mined(spark, rows, positives=3, negatives=4) == brute(rows, positives=3, take=4)
