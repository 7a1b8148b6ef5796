"""Forests grown from a table: no row is lost between tasks, and walks in tasks agree with one walk over all trees."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaitframe.operators import forest as FO
from gaitframe.operators import models as MO
from gaitframe.session import materialize


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ("a", "b", "c")[i % 3], [float(rng.normal() + (i % 3)), float(rng.integers(4)), 1.0, float(rng.normal())]) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, label string, x array<double>").withColumn("features", array_to_vector("x")).drop("x").repartition(5).cache()


@pytest.mark.parametrize("rows, passes", [(FO.ROWS, FO.OPEN), (200, 3)])
def test_subtrees_are_small_and_hold_every_drawn_row(spark, table, monkeypatch, rows, passes):
    monkeypatch.setattr(FO, "ROWS", rows)
    monkeypatch.setattr(FO, "OPEN", passes)
    monkeypatch.setattr(FO, "GROUP", 2)
    model = MO.fit_forest(table, trees=5, depth=9, min_leaf=2)
    held = [r.asDict() for r in FO.subtrees(spark, model).collect()]
    sizes = [int(np.frombuffer(r["counts"], np.int32).reshape(-1, 3)[0].sum()) for r in held if r["node"] >= 0]
    assert len(sizes) >= 5 and max(sizes) <= max(rows, 200) and (rows > 3000 or len(sizes) > 50)
    trees = FO.assemble(held, 3, 9)
    cells = FO.binned(model.scale, model.cuts, table, {"id": F.col("id")}).collect()
    bins = np.frombuffer(b"".join(r.bins for r in cells), np.uint8).reshape(len(cells), -1)
    total, ends = np.zeros((len(bins), 3)), [*trees.roots[1:], len(trees.feature)]
    for root, end in zip(trees.roots, ends):
        leaf = trees.feature[root:end] < 0
        drawn = trees.counts[root:end][leaf].sum()
        assert 2700 < drawn < 3300 and (trees.counts[root:end][leaf].sum(axis=1) >= 2).all()
        inner = np.flatnonzero(~leaf) + root
        assert (trees.counts[inner] == trees.counts[trees.left[inner]] + trees.counts[trees.left[inner] + 1]).all()
        total += FO.votes(trees, FO.walk(trees, root, bins), np.array(model.class_weights))
    want = {r.id: v for r, v in zip(cells, total / 5)}
    got = {r.id: (r.prediction, np.array(r.probabilities)) for r in MO.predict(model, table).collect()}
    assert len(got) == 3000 and max(np.abs(got[i][1] - want[i]).max() for i in got) < 1e-8
    assert np.mean([p == ("a", "b", "c")[i % 3] for i, (p, _) in got.items()]) > 0.6
    gains = FO.importances(spark, model)
    assert sum(gains) == pytest.approx(1) and gains[0] == max(gains) and gains[2] == 0


def test_empty_rows_are_scored(table):
    model = MO.fit_forest(table, trees=2, depth=3)
    assert MO.predict(model, table.limit(0)).collect() == []


def test_portions_of_trees_and_repeats_give_the_same(spark, table, monkeypatch):
    assert [list(p) for p in FO.portions(5, 3)] == [[0, 1, 2, 3, 4]] and [len(p) for p in FO.portions(5, FO.SHUFFLED)] == [1] * 5
    assert [len(p) for p in FO.portions(5, FO.SHUFFLED / 2)] == [2, 2, 1] and FO.portions(0, 9.0) == []
    written = materialize(table, "forest-table")

    def made():
        model = MO.fit_forest(written, trees=5, depth=6, min_leaf=2)
        drops = MO.permutation_importance(model, written, ["p", "q", "r", "s"], "a", 3, ["id"])
        return sorted(map(str, FO.subtrees(spark, model).collect())), sorted((r[0], round(r[1], 9)) for r in drops.collect())

    whole = made()
    monkeypatch.setattr(FO, "SHUFFLED", 3000)
    assert made() == whole


def test_a_written_table_leaves_no_shuffle_files(spark):
    held, key = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        found = held.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before, known = spark.conf.get(key), shuffled()
    materialize(spark.range(50_000).repartition(3, "id"), "freed")
    deadline = time.time() + 20
    while shuffled() - known and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - known and spark.conf.get(key) == before
