import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.llm import embeddings


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    sizes = [len(v) for _, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    d = max(set(sizes), key=lambda n: (sizes.count(n), -n)) if sizes else 0
    ok = [bool(v) and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.array([v if good else [1.0] * max(d, 1) for (_, v), good in zip(rows, ok, strict=True)], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= cosine) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
        label[root(int(j))] = root(int(i))
    names = {}
    for i, name in enumerate(ids):
        if name is not None:
            names[root(i)] = min(name, names.get(root(i), name))
    return sorted((str(ids[i]), int(near[i].sum()), str(names.get(root(i))), ids[i] is not None and names.get(root(i)) == ids[i]) for i in range(len(rows)))


def cases(kind):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 12))
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        v = base[rng.integers(20)] + rng.normal(size=12) * rng.choice([0.02, 0.2, 0.4])
        rows.append((1000 + i, (v * rng.choice([1, 1e-3, 50])).tolist()))
    rows += [(2000 + i, base[3].tolist()) for i in range(60)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [float("nan")] + [1.0] * 11), (3004, [None] + [1.0] * 11),
             (3005, [float("inf")] + [1.0] * 11), (3006, [1.0] * 5), (None, base[3].tolist()), (7, base[5].tolist()), (-4, base[7].tolist())]
    return rows if kind == "double" else [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("kind,block,fan", [("double", 2048, 16), ("float", 16, 2), ("double", 40, 16)])
def test_against_brute_force(spark, monkeypatch, kind, block, fan):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "FAN", fan)
    rows = cases(kind)
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("key", F.lit("clash")).withColumn("label", F.lit(1))
    got = embeddings.similar_vectors(frame).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_far_intervals_are_skipped(spark, monkeypatch):
    """Two bands of vectors that cannot link meet in no pair of runs."""
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "FAN", 2)
    boxes = [(i, *([float(i < 8)] + [0.0] * 7), *([float(i < 8) + 0.1] + [0.0] * 7)) for i in range(16)]
    names = ", ".join(["run long", *(f"{s}{i} double" for s in ("lo", "hi") for i in range(8))])
    pairs = {(r.a, r.b) for r in embeddings._run_pairs(spark.createDataFrame(boxes, names), 16, 0.4).collect()}
    assert pairs == {(a, b) for a in range(16) for b in range(a, 16) if (a < 8) == (b < 8)}


def test_real_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in frame.collect()]
    got = embeddings.similar_vectors(frame).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_empty(spark):
    assert embeddings.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = embeddings.similar_vectors(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in only] == [(4, 0, 4, True)]


def test_vectors_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(8)
    base = {n: rng.normal(size=n).tolist() for n in (4, 9)}
    rows = [(10 * n + i, base[n][:] if i < 3 else rng.normal(size=n).tolist()) for n in (4, 9) for i in range(40 if n == 4 else 12)] + [(1, None), (2, [])]
    got = {r.vec_id: r for r in embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.999).collect()}
    assert len(got) == len(rows)
    assert all(got[10 * n + i].component_id == 10 * n and got[10 * n + i].n_links == 2 for n in (4, 9) for i in range(3))
    assert got[1].kept and got[2].n_links == 0
