"""Composed studies: baselines, label shuffle, stress, cross-dataset and cohort experiments.

Each function writes its feature table once and fits on it (runs jobs).
"""

import logging
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.operators import audits as Q
from gaitframe.operators import held_out as H
from gaitframe.operators import metrics as M
from gaitframe.operators import models as MO
from gaitframe.operators import splits as G
from gaitframe.operators.features import extract_features
from gaitframe.session import materialize, scratch_path

log = logging.getLogger(__name__)
KEYS = ["recording_id", "segment", "k"]

Fit = Callable[[DataFrame], PipelineModel]


def feature_vectors(windows: DataFrame) -> DataFrame:
    """Keys, subject, dataset, label and ``features`` of every window, written once."""
    rows = MO.with_vector(extract_features(windows))
    return materialize(rows.select(*KEYS, "subject_id", "dataset_id", "label", "features"), "features")


def holdout(vectors: DataFrame, frac: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    split = G.group_shuffle(vectors, frac, seed)
    return G.not_in_split(vectors, split, "test"), G.in_split(vectors, split, "test")


def baselines(train: DataFrame, test: DataFrame, forest: PipelineModel | None = None) -> DataFrame:
    """Accuracy, macro F1 and fall recall of the simple models beside the full forest."""
    scored = {
        "Majority Class": MO.majority_baseline(train, test),
        "Logistic Regression": MO.predict(MO.fit_logistic(train), test),
        "Decision Tree (depth=3)": MO.predict(MO.fit_tree(train, 3), test),
        "Decision Tree (depth=6)": MO.predict(MO.fit_tree(train, 6), test),
        "Full Random Forest": MO.predict(forest or MO.fit_forest(train), test),
    }
    return M.comparison(scored).drop("fall_f1")


def label_shuffle(train: DataFrame, test: DataFrame, limit: float = 0.30, classes: int = 6) -> DataFrame:
    """Scores after training on permuted labels; fails the check above ``limit``."""
    shuffled = materialize(MO.shuffle_labels(train), "shuffled")
    scores = M.overall(MO.predict(MO.fit_forest(shuffled), test))
    return scores.select(
        F.lit(1.0 / classes).alias("chance_level"), F.col("accuracy").alias("shuffled_accuracy"),
        F.col("macro_f1").alias("shuffled_macro_f1"), (F.col("accuracy") <= limit).alias("passed"))


def stress_table(model: PipelineModel, windows: DataFrame, stresses: dict | None = None) -> DataFrame:
    """Accuracy and fall recall of a fitted model on changed windows."""
    out = None
    for name, change in (Q.STRESSES if stresses is None else stresses).items():
        scored = MO.predict(model, MO.with_vector(extract_features(change(windows))).select("label", "features"))
        row = M.evaluate(scored).select(F.lit(name).alias("condition"), "accuracy", "fall_recall", "fpr")
        out = row if out is None else out.unionByName(row)
    return out


def cross_dataset(vectors: DataFrame, test_dataset: str = "kfall", fit: Fit = MO.fit_forest) -> DataFrame:
    """Experiments A, B and C (C only with own recordings) as one row each.

    A failing experiment is logged, leaves its message in ``error``, and the others still run.
    """
    spark = vectors.sparkSession
    plan = [("A", None), ("B", test_dataset)]
    if not vectors.filter(F.col("dataset_id") == G.OWN_DATASET).isEmpty():
        plan.append(("C", None))
    out = None
    for name, held in plan:
        try:
            rows = materialize(G.experiment(vectors, name, held), f"experiment-{name}")
            model = fit(rows.filter("split = 'train'"))
            row = M.evaluate(MO.predict(model, rows.filter("split = 'test'"))).select(
                F.lit(name).alias("experiment"), "accuracy", "macro_f1", "weighted_f1", "fall_recall",
                F.lit(None).cast("string").alias("error"))
        except Exception as failure:
            log.error("experiment %s failed: %s", name, failure)
            row = spark.createDataFrame(
                [(name, str(failure))], "experiment string, error string").select(
                "experiment", *[F.lit(None).cast("double").alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "fall_recall")], "error")
        out = row if out is None else out.unionByName(row)
    return out


def scored_folds(rows: DataFrame, k: int, fit: Fit, parts: Sequence[str] = ("train", "val"), parallelism: int = 4) -> DataFrame:
    """``fold, part, subject_id, label, prediction`` of ``k`` models, each fitted without the rows of its ``fold`` (runs jobs).

    ``rows`` is a written table with ``fold`` (a row without one is in every training part). ``parallelism`` folds are fitted
    at a time; each writes its scored rows, so a lost driver step or executor costs one fold, and no plan grows with ``k``.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "scored-folds")

    @inheritable_thread_target(spark)
    def one(fold: int) -> list[str]:
        side = {"train": rows.filter(~F.col("fold").eqNullSafe(fold)), "val": rows.filter(F.col("fold") == fold)}
        model, written = fit(side["train"]), []
        for part in parts:
            scored = MO.predict(model, side[part].drop("fold")).select(F.lit(fold).alias("fold"), F.lit(part).alias("part"), "subject_id", "label", "prediction")
            scored.write.parquet(f"{path}/{part}-{fold}")
            written.append(f"{path}/{part}-{fold}")
        return written

    with ThreadPool(parallelism) as pool:
        found = [p for paths in pool.map(one, range(k), chunksize=1) for p in paths]
    kind = "fold int, part string, subject_id string, label string, prediction string"
    return spark.read.schema(kind).parquet(*found) if found else spark.createDataFrame([], kind)


def cross_validate(vectors: DataFrame, k: int = 5, fit: Fit = MO.fit_forest, name: str = "Random Forest", parallelism: int = 4) -> DataFrame:
    """Scored rows of a subject-grouped k-fold: ``model``, ``fold``, ``part``, ``subject_id``, ``label``, ``prediction``. With fewer
    than ``k`` subjects there are as many folds (runs jobs)."""
    folds = materialize(G.group_kfold(vectors, k), "folds")
    rows = materialize(vectors.join(folds.select("subject_id", "fold"), "subject_id"), "folded")
    used = (folds.agg(F.max("fold")).first()[0] + 1) if not folds.isEmpty() else 0
    return scored_folds(rows, used, fit, parallelism=parallelism).select(F.lit(name).alias("model"), "*")


def leave_one_subject_out(vectors: DataFrame, fit: Fit = MO.fit_forest, subjects: list[str] | None = None, parallelism: int = 4) -> DataFrame:
    """Scored rows per held-out subject, named by ``fold``. One model per subject: give ``subjects`` to fit fewer (runs jobs).

    Subjects are numbered by rank on the cluster; the driver learns how many there are. Trees (``MO.TreeFit``) are fitted
    together, sharing the nodes in which they agree (:mod:`gaitframe.operators.held_out`).
    """
    named = vectors.select("subject_id").distinct()
    if subjects is not None:
        named = named.filter(F.col("subject_id").isin(subjects))
    numbered = materialize(G.shuffled_rank(named, [], 42, "subject_id").withColumnRenamed("rank", "fold"), "subjects")
    rows = materialize(vectors.join(numbered, "subject_id", "left"), "folded")
    if isinstance(fit, MO.TreeFit):
        scored = H.predictions(rows, fit.depth)
    else:
        scored = scored_folds(rows, numbered.count(), fit, ("val",), parallelism)
    return scored.select(F.col("subject_id").alias("fold"), "label", "prediction")


def real_data_report(windows: DataFrame, own_windows: DataFrame, fit: Fit = MO.fit_forest) -> DataFrame:
    """Unseen subjects (A), young to older (C), public to own recordings (D), tilt and speed.

    ``windows`` are public ones with ``age_group``, a written table, as it is read several times; ``own_windows`` come from own
    recordings. C and D are left out when a cohort or the own recordings are missing.
    """
    cohort = windows.select(*KEYS, "age_group")
    vectors = feature_vectors(windows)
    train, test = (materialize(part, "part") for part in holdout(vectors))
    model = fit(train)
    by_age = G.cohort_split(vectors.join(cohort, KEYS))
    young, older = (materialize(by_age.filter(F.col("split") == s), "cohort") for s in ("train", "test"))
    own = feature_vectors(own_windows)
    test_windows = windows.join(test.select(*KEYS), KEYS, "left_semi")
    parts = {"A unseen subjects": MO.predict(model, test)}
    if not young.isEmpty() and not older.isEmpty():
        parts["C young to older"] = MO.predict(fit(young), older)
    if not own.isEmpty():
        parts["D public to own"] = MO.predict(model, own)
    for name, change in (("tilt", Q.tilt_windows), ("speed", Q.speed_windows)):
        parts[name] = MO.predict(model, MO.with_vector(extract_features(change(test_windows))).select("label", "features"))
    out = None
    for name, scored in parts.items():
        row = M.evaluate(scored).withColumn("experiment", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
