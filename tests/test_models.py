"""Models on data with a known answer."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaitframe.operators import metrics as M
from gaitframe.operators import models as MO
from gaitframe.operators import windows as W
from gaitframe.plans import experiments as X
from gaitframe.schema import SENSORS


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        label = ("falling", "lying", "walking")[i % 3]
        rows.append((f"r{i}", 0, 0, f"s{i % 12}", ("kfall", "own")[i % 2], label,
                     [float(rng.normal() + 6 * (i % 3)), float(rng.normal()), float(rng.normal())]))
    df = spark.createDataFrame(rows, "recording_id string, segment int, k long, subject_id string, dataset_id string, label string, x array<double>")
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


def accuracy(model, df):
    return M.overall(MO.predict(model, df)).first()["accuracy"]


def test_classifiers_learn_and_round_trip(spark, vectors, tmp_path):
    forest = MO.fit_forest(vectors, trees=10, depth=4)
    assert accuracy(forest, vectors) > 0.97 and MO.label_order(forest) == ["falling", "lying", "walking"]
    probs = MO.predict(forest, vectors).select("probabilities").collect()
    assert all(abs(sum(p[0]) - 1) < 1e-9 for p in probs)
    MO.save_model(forest, str(tmp_path / "m"))
    again = MO.load_model(str(tmp_path / "m"))
    assert MO.label_order(again) == MO.label_order(forest) and accuracy(again, vectors) == accuracy(forest, vectors)
    assert accuracy(MO.fit_logistic(vectors), vectors) > 0.95 and accuracy(MO.fit_tree(vectors, 3), vectors) > 0.95
    assert accuracy(MO.fit_perceptron(vectors, hidden=(8,), iterations=60), vectors) > 0.95
    gains = {r[0]: r[1] for r in MO.impurity_importance(forest, ["a", "b", "c"], spark).collect()}
    assert gains["a"] > 0.8


def test_unseen_label_does_not_stop_scoring(vectors):
    tree = MO.fit_tree(vectors.filter("label <> 'walking'"), 3)
    assert MO.predict(tree, vectors).filter("label = 'walking'").count() == 80


def test_permutation_importance_finds_the_feature(vectors):
    model = MO.fit_fall_forest(vectors, trees=10, depth=4)
    got = {r["feature"]: r["fall_perm_importance"] for r in MO.permutation_importance(model, vectors, ["a", "b", "c"], repeats=3).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] > 0.3 and abs(got["b"]) < 0.1 and abs(got["c"]) < 0.1


@pytest.mark.parametrize("depth", [2, 6])
def test_permutation_importance_equals_scoring_copies(spark, vectors, depth):
    """The walk over node arrays gives the numbers that the model gives for copied rows."""
    from pyspark.ml.functions import vector_to_array
    model, keys, names = MO.fit_fall_forest(vectors, trees=9, depth=depth), ["recording_id", "segment", "k"], ["a", "b", "c"]
    got = {r["feature"]: r["fall_perm_importance"] for r in MO.permutation_importance(model, vectors, names, repeats=4).collect()}
    rows = vectors.select(*keys, "label", vector_to_array("features").alias("x"))
    both = rows.join(MO.shuffled_by(rows.withColumnRenamed("x", "y"), keys, ["y"], range(1, 5)), keys).collect()
    base = M.safety(MO.predict(model, vectors)).first()["fall_f1"]
    for i, name in enumerate(names):
        copies = spark.createDataFrame([(r.label, r.seed, [r.y[j] if j == i else v for j, v in enumerate(r.x)]) for r in both], "label string, seed int, x array<double>")
        scored = MO.predict(model, copies.withColumn("features", array_to_vector("x")))
        want = base - M.safety(scored, ["seed"]).agg(F.avg("fall_f1")).first()[0]
        assert got[name] == pytest.approx(want, abs=1e-12)


def test_leave_one_subject_out_fits_without_the_subject(vectors):
    seen = []

    def fit(train):
        seen.append({r[0] for r in train.select("subject_id").distinct().collect()})
        return MO.fit_tree(train, 3)

    scored = X.leave_one_subject_out(vectors, fit)
    assert sorted(12 - len(s) for s in seen) == [1] * 12 and len(set.union(*seen)) == 12
    assert {r.fold: r.n for r in scored.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {f"s{i}": 20 for i in range(12)}
    assert M.overall(scored).first()["accuracy"] > 0.95


def test_folds_of_few_subjects_and_of_nothing(vectors):
    two = vectors.filter("subject_id IN ('s0', 's1', 's2')")
    scored = X.cross_validate(two, 5, lambda train: MO.fit_tree(train, 2))
    assert {r.fold for r in scored.select("fold").distinct().collect()} == {0, 1, 2} and scored.filter("part = 'val'").count() == 60
    assert X.leave_one_subject_out(vectors.limit(0)).count() == 0


def test_shuffled_labels_are_a_permutation(vectors):
    shuffled = MO.shuffle_labels(vectors)
    before, after = ({r[0]: r[1] for r in d.groupBy("label").count().collect()} for d in (vectors, shuffled))
    moved = vectors.select("recording_id", "label").join(shuffled.select("recording_id", F.col("label").alias("other")), "recording_id")
    assert before == after and 20 < moved.filter("label = other").count() < 140


def test_majority_and_best(vectors):
    train = vectors.filter("label <> 'lying'").unionByName(vectors.filter("label = 'lying'").limit(3))
    assert {r[0] for r in MO.majority_baseline(train, vectors).select("prediction").distinct().collect()} == {"falling"}
    table = vectors.sparkSession.createDataFrame([("a", 0.9, 0.5), ("b", 0.9, 0.6), ("c", 0.8, 0.99)], "model string, fall_recall double, macro_f1 double")
    assert M.best_model(table).first()["model"] == "b"


def quick(train):
    return MO.fit_forest(train, trees=5, depth=3)


def test_experiments_and_cross_validation(vectors):
    rows = {r["experiment"]: r for r in X.cross_dataset(vectors, fit=quick).collect()}
    assert set(rows) == {"A", "B", "C"} and all(r["accuracy"] > 0.9 for r in rows.values())
    failing = {r["experiment"]: r["error"] for r in X.cross_dataset(vectors.filter("dataset_id = 'kfall'"), fit=quick).collect()}
    assert failing["A"] is None and failing["B"] and "C" not in failing  # nothing is left to train on
    summary = M.cv_summary(M.cv_folds(X.cross_validate(vectors, 3, quick))).first()
    assert summary["val_acc_mean"] > 0.9 and abs(summary["gap_mean"]) < 0.1
    loso = M.loso_table(X.leave_one_subject_out(vectors, quick, ["s0", "s1"]), ["falling", "lying", "walking"])
    assert {r["fold"] for r in loso.collect()} == {"s0", "s1"}


def test_label_shuffle_falls_to_chance(vectors):
    train, test = X.holdout(vectors)
    row = X.label_shuffle(train, test, limit=0.6, classes=3).first()
    assert row["shuffled_accuracy"] < 0.6 and row["passed"]


def test_augmentation_is_bounded_and_repeatable(spark):
    values = ", ".join(f"'{c}', 10D" for c in SENSORS)
    sample = f"transform(sequence(0, 99), i -> named_struct('at', i, 'timestamp', i * 20L, {values}, 'label', 'walking'))"
    windows = spark.sql(f"SELECT concat('r', id) AS recording_id, 0 AS segment, 0L AS k, {sample} AS samples FROM range(400)")
    one, two = (W.explode_windows(MO.augment_windows(windows)).agg(*[F.sum(c) for c in SENSORS], F.min("ax"), F.max("ax")).first() for _ in range(2))
    assert one == two
    silent = W.explode_windows(MO.augment_windows(windows)).groupBy("recording_id").agg(F.max(F.abs("ax")).alias("m")).filter("m = 0").count()
    assert 4 < silent < 45
    spread = W.explode_windows(MO.augment_windows(windows, dropout=0.0)).agg(F.min("ax"), F.max("ax"), F.avg("ax")).first()
    assert 9.1 < spread[0] and spread[1] < 10.9 and abs(spread[2] - 10) < 0.05


def test_gates_need_three_still_ticks(spark):
    flags = [True, True, True, True, False, True, True, False]
    rows = [("r", i, i * 400, s, False, False, "lying", "running") for i, s in enumerate(flags)]
    df = spark.createDataFrame(rows, "recording_id string, tick long, tick_ts long, stationary boolean, gentle boolean, low_power boolean, posture string, model_label string")
    df = df.withColumn("model_probs", F.array(*[F.lit(v) for v in (0.1, 0.1, 0.5, 0.1, 0.1, 0.1)]))
    got = MO.on_device_gates(df).orderBy("tick").collect()
    assert [r["still_ticks"] for r in got] == [1, 2, 3, 4, 0, 1, 2, 0]
    assert [r["label"] for r in got] == ["running", "running", "lying", "lying"] + ["running"] * 4
    assert got[2]["confidence"] == 0.95 and sum(got[2]["probabilities"]) == pytest.approx(1.0)
