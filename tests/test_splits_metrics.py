"""Split rules, fold assignment, leakage errors, and metrics against hand-made counts."""

import heapq

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaitframe.operators import metrics as M
from gaitframe.operators import reports as A
from gaitframe.operators import splits as G


def greedy(sizes, k):
    heap = [(0, f) for f in range(k)]
    out = []
    for size, groups in sizes:
        for _ in range(groups):
            load, f = heapq.heappop(heap)
            out.append((size, f))
            heapq.heappush(heap, (load + size, f))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_fold_schedule_is_the_greedy_rule(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted({int(s): int(n) for s, n in zip(rng.integers(1, 400, 6), rng.integers(1, 60, 6))}.items(), reverse=True)
    k = int(rng.integers(1, 7))
    plan = [(size, turn[i % len(turn)]) for size, start, end, turn in G.fold_schedule(sizes, k) for i in range(end - start)]
    assert plan == greedy(sizes, k)


def test_fold_schedule_is_short_for_many_groups():
    plan = G.fold_schedule([(1_000_000, 1), (3, 10), (1, 10**9)], 5)
    assert len(plan) <= 15 and sum(e - s for _, s, e, _ in plan) == 10**9 + 11


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"{d}_{i}", d, f"{d}_{i}_r{j}") for d, n in (("big", 20), ("own", 7), ("pair", 2), ("single", 1)) for i in range(n) for j in range(3)]
    return spark.createDataFrame(data, "subject_id string, dataset_id string, recording_id string")


def test_subject_split_sizes(rows):
    got = {(r["dataset_id"], r["split"]): r["count"] for r in G.subject_split(rows).groupBy("dataset_id", "split").count().collect()}
    # 20: 4 test, round(2.4) = 2 validation; 7: 1 and 1; 2 and 1 are too few for three parts
    assert got == {("big", "test"): 4, ("big", "validation"): 2, ("big", "train"): 14, ("own", "test"): 1, ("own", "validation"): 1,
                   ("own", "train"): 5, ("pair", "test"): 1, ("pair", "train"): 1, ("single", "test"): 1}


def test_splits_are_disjoint_complete_and_repeatable(rows):
    for build in (lambda: G.subject_split(rows), lambda: G.holdout_split(rows, F.col("dataset_id") == "own"), lambda: G.group_shuffle(rows, 0.3)):
        first, second = ({r["subject_id"]: r["split"] for r in build().collect()} for _ in range(2))
        assert first == second and len(first) == 30
    assert G.holdout_split(rows, F.col("dataset_id") == "own").groupBy("split").count().filter("split = 'validation'").first()["count"] == 3
    assert G.group_shuffle(rows, 0.3).filter("split = 'test'").count() == 9


def test_kfold_and_loso(rows):
    folds = G.group_kfold(rows, 4).collect()
    loads = np.bincount([r["fold"] for r in folds], weights=[r["n_rows"] for r in folds])
    assert len(folds) == 30 and loads.max() - loads.min() <= 3
    loso = G.loso_folds(rows.withColumn("k", F.lit(0))).collect()
    assert len(loso) == 30 and all(r["n_test"] == 3 and r["n_train"] == 87 for r in loso)


def test_leakage_fails_the_job(spark, rows):
    split = G.subject_split(rows)
    assert G.assert_no_leakage(split).filter("n_splits <> 1").count() == 0
    leaky = split.unionByName(split.filter("split = 'test'").withColumn("split", F.lit("train")))
    with pytest.raises(PySparkException, match="leakage"):
        G.assert_no_leakage(leaky).collect()


def test_unknown_experiment(rows):
    with pytest.raises(ValueError):
        G.experiment(rows, "B")
    with pytest.raises(ValueError):
        G.experiment(rows, "Z")


def test_metrics_on_small_counts(spark):
    pairs = [("falling", "falling")] * 3 + [("falling", "walking")] + [("walking", "falling")] * 2 + [("walking", "walking")] * 4 + [("lying", "sitting")]
    scored = spark.createDataFrame(pairs, "label string, prediction string")
    s = M.safety(scored).first()
    assert (s["tp"], s["fn"], s["fp"], s["tn"]) == (3, 1, 2, 5)
    assert abs(s["fall_recall"] - 0.75) < 1e-12 and abs(s["fall_precision"] - 0.6) < 1e-12 and abs(s["fpr"] - 2 / 7) < 1e-12
    o = M.overall(scored).first()
    f = {"falling": 2 * 0.6 * 0.75 / 1.35, "walking": 2 * 0.8 * (4 / 6) / (0.8 + 4 / 6), "lying": 0.0, "sitting": 0.0}
    assert abs(o["accuracy"] - 7 / 11) < 1e-12 and abs(o["macro_f1"] - sum(f.values()) / 4) < 1e-12
    assert abs(o["balanced_accuracy"] - (0.75 + 4 / 6 + 0) / 3) < 1e-12
    assert M.fall_report(scored).first()["below_target"]
    table = M.confusion_table(scored, ["falling", "walking", "lying", "sitting"]).collect()
    assert len(table) == 16 and sum(r["n"] for r in table) == len(pairs)


def test_metrics_without_falls_are_zero(spark):
    s = M.safety(spark.createDataFrame([("walking", "walking")], "label string, prediction string")).first()
    assert s["fall_recall"] == s["fall_precision"] == s["fall_f1"] == s["fnr"] == 0.0 and s["specificity"] == 1.0


def test_class_weights_follow_scale_then_floor(spark):
    df = spark.createDataFrame([("a",)] * 1000 + [("b",)] * 10 + [("c",)] * 1, "label string")
    got = {r["label"]: r["weight"] for r in A.class_weights(df).collect()}
    w = np.array([1011 / 1000, 1011 / 10, 1011.0])
    w = w / w.sum() * 3
    np.testing.assert_allclose([got["a"], got["b"], got["c"]], np.maximum(w, 0.1 * w.max()))


def test_histogram_of_equal_durations(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(5) for _ in range(10)], "recording_id string")
    rows = A.duration_histogram(df).orderBy("bin").collect()
    assert len(rows) == 40 and [r["bin"] for r in rows if r["n_recordings"]] == [21] and sum(r["n_recordings"] for r in rows) == 5
