"""Leave-one-out trees against trees grown one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaitframe.operators import held_out as H
from gaitframe.operators import models as MO
from gaitframe.plans import experiments as X


def plain(bins, y, train, row, depth, classes):
    """Class of ``row`` by a tree grown on ``train`` alone, scoring every split."""
    while True:
        counts = np.bincount(y[train], minlength=classes)
        node = H.Node(H.histogram(bins[train], y[train], classes))
        whole = (counts ** 2).sum() / counts.sum()
        at = int(node.score.argmax())
        if depth == 0 or node.score[at] <= whole * (1 + 1e-9):
            return counts.argmax()
        feature, cut = at // (H.BINS - 1), at % (H.BINS - 1)
        train, depth = train[(bins[train, feature] <= cut) == (bins[row, feature] <= cut)], depth - 1


def test_shared_nodes_give_the_tree_of_every_fold():
    rng = np.random.default_rng(5)
    bins, fold = rng.integers(0, 32, (240, 6)).astype(np.uint8), rng.integers(0, 30, 240)
    y = (bins[:, 0] // 12 + (rng.random(240) < 0.3) * rng.integers(0, 3, 240)) % 3
    got = H.finish(bins, y, fold, np.arange(240), 4, 3)
    assert got.tolist() == [plain(bins, y, np.flatnonzero(fold != fold[r]), r, 4, 3) for r in range(240)]


@pytest.fixture(scope="module")
def vectors(spark):
    x = F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000.0 for j in range(5)])
    rows = spark.range(1200).select(F.col("id").cast("string").alias("recording_id"), F.lit(0).alias("segment"), F.lit(0).alias("k"),
                                    F.concat(F.lit("s"), F.col("id") % 80).alias("subject_id"), x.alias("x"))
    label = F.when(F.col("x")[0] + F.col("x")[1] * 0.5 > 0.8, "walking").when(F.col("x")[2] > 0.6, "lying").otherwise("falling")
    return rows.withColumns({"label": label, "features": array_to_vector("x")}).drop("x").localCheckpoint()


def test_all_trees_together_take_few_jobs_and_no_fit_per_subject(vectors, monkeypatch):
    def refuse(*_):
        raise AssertionError("a tree was fitted alone")

    monkeypatch.setattr(MO, "fit_tree", refuse)
    scored = X.leave_one_subject_out(vectors, MO.TreeFit(6)).localCheckpoint()
    assert {(r.fold, r["count"]) for r in scored.groupBy("fold").count().collect()} == {(f"s{i}", 15) for i in range(80)}
    assert scored.filter("label = prediction").count() > 1100


def test_passes_and_groups_agree(vectors, monkeypatch):
    def table():
        return sorted(map(tuple, X.leave_one_subject_out(vectors, MO.TreeFit(4)).collect()))

    whole = table()
    monkeypatch.setattr(H, "ROWS", 100)
    assert table() == whole
    monkeypatch.setattr(H, "ROWS", 3)  # a fold's rows are added up as a histogram
    assert table() == whole


def test_nothing_to_fit_on_and_rows_of_no_fold(vectors):
    assert X.leave_one_subject_out(vectors.limit(0), MO.TreeFit(2)).count() == 0
    with pytest.raises(ValueError, match="no rows to fit on"):
        X.leave_one_subject_out(vectors.filter("subject_id = 's1'"), MO.TreeFit(2))
    one = X.leave_one_subject_out(vectors, MO.TreeFit(2), ["s1"])
    assert {(r.fold, r["count"]) for r in one.groupBy("fold").count().collect()} == {("s1", 15)}
