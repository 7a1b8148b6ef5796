"""Activity and fall classifiers with Spark ML, importances, augmentation and on-device gates.

Training frames are written once to the shared folder (:func:`gaitframe.session.materialize`):
fitting passes over them several times.
"""

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import IndexToString, StandardScaler, StandardScalerModel, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators import forest as FO
from gaitframe.operators import metrics as M
from gaitframe.operators.features import feature_names
from gaitframe.operators.ordered import carry_forward, time_slice
from gaitframe.operators.perceptron import ArrayPerceptron
from gaitframe.operators.reports import balanced_weights
from gaitframe.operators.splits import shuffled_rank
from gaitframe.schema import FALL, SENSORS, SLICE_MS, VALID_LABELS
from gaitframe.session import materialize

# The forest's parameters.
TREES, DEPTH, MIN_LEAF, SEED = 200, 16, 4, 42
FALL_TREES, REPEATS = 100, 10


def with_vector(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``features`` vector from the feature columns; missing values (constant channels) become 0."""
    names = feature_names() if names is None else names
    return df.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])))


def with_window_vector(windows: DataFrame) -> DataFrame:
    """``features`` vector from the raw samples of a window, in sample order."""
    flat = F.flatten(F.transform("samples", lambda s: F.array(*[s[c] for c in SENSORS])))
    return windows.withColumn("features", array_to_vector(flat))


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class; the weight table has one row per class and is broadcast."""
    return df.join(F.broadcast(balanced_weights(df, label)), label)


def _stages(label: str, classifier) -> list:
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    scale = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True)
    classifier.setFeaturesCol("_scaled").setLabelCol("_label").setPredictionCol("_pred")
    return [index, scale, classifier]


def _fit(train: DataFrame, classifier, label: str = "label") -> PipelineModel:
    """Fit index, scaler and classifier; the label order travels with the model."""
    stages = _stages(label, classifier)
    index = stages[0].setHandleInvalid("error").fit(train)
    index.setHandleInvalid("keep")
    back = IndexToString(inputCol="_pred", outputCol="prediction", labels=index.labels)
    fitted = Pipeline(stages=stages[1:]).fit(index.transform(train))
    return PipelineModel([index, *fitted.stages, back])


def fit_forest(train: DataFrame, trees: int = TREES, depth: int = DEPTH, min_leaf: int = MIN_LEAF,
               seed: int = SEED, label: str = "label") -> FO.ForestModel:
    """Scaled random forest with balanced class weights (:mod:`gaitframe.operators.forest`; runs jobs). ``train`` has ``features``."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error").fit(train)
    scale = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(train)
    weight = {r[label]: r["weight"] for r in balanced_weights(train, label).collect()}
    rows = index.transform(train.select(label, "features")).drop(label)
    return FO.fit(rows, list(index.labels), [weight[c] for c in index.labels], scale, trees, depth, min_leaf, seed)


def fit_fall_forest(train: DataFrame, trees: int = FALL_TREES, depth: int = DEPTH, seed: int = SEED) -> FO.ForestModel:
    binary = train.withColumn("label", F.when(F.col("label") == FALL, FALL).otherwise("other"))
    return fit_forest(binary, trees, depth, 1, seed)


def fit_logistic(train: DataFrame, iterations: int = 500) -> PipelineModel:
    """Multinomial regression; the penalty equals a unit inverse strength on summed losses."""
    model = LogisticRegression(family="multinomial", maxIter=iterations, regParam=1.0 / train.count(), standardization=False)
    return _fit(train, model)


def fit_tree(train: DataFrame, depth: int, seed: int = SEED) -> PipelineModel:
    return _fit(train, DecisionTreeClassifier(maxDepth=depth, seed=seed))


class TreeFit(NamedTuple):
    """:func:`fit_tree` of a depth as a value, so that leave-one-subject-out can fit all its trees together."""

    depth: int

    def __call__(self, train: DataFrame) -> PipelineModel:
        return fit_tree(train, self.depth)


def fit_perceptron(train: DataFrame, hidden: Sequence[int] = (64,), iterations: int = 100, seed: int = SEED) -> PipelineModel:
    """Perceptron over raw windows (``features`` from :func:`with_window_vector`), fitted by arrays
    (:mod:`gaitframe.operators.perceptron`; runs jobs)."""
    first = train.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    classes = train.select("label").distinct().count()
    return _fit(train, ArrayPerceptron(layers=[first, *hidden, classes], maxIter=iterations, seed=seed))


def predict(model: PipelineModel | FO.ForestModel, df: DataFrame) -> DataFrame:
    """``prediction`` label and ``probabilities`` in label order. A forest scores written rows (runs jobs)."""
    if isinstance(model, FO.ForestModel):
        return _predict_forest(model, df)
    scored = model.transform(df)
    drop = [c for c in ("_label", "_scaled", "_pred", "rawPrediction", "probability", "features") if c in scored.columns]
    if "probability" in scored.columns:
        scored = scored.withColumn("probabilities", vector_to_array("probability"))
    return scored.drop(*drop)


def _predict_forest(model: FO.ForestModel, df: DataFrame) -> DataFrame:
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "to-score")
    found = FO.probabilities(model, rows, "_row")
    best = C.arg_max("probabilities", F.array(*[F.lit(c) for c in model.labels])).alias("prediction")
    return materialize(rows.drop("features").join(found.select("_row", best, "probabilities"), "_row").drop("_row"), "scored")


def label_order(model: PipelineModel | FO.ForestModel) -> list[str]:
    return list(model.labels if isinstance(model, FO.ForestModel) else model.stages[0].labels)


_FOREST = "labels array<string>, class_weights array<double>, cuts array<array<double>>, trees int, depth int"


def save_model(model: PipelineModel | FO.ForestModel, path: str) -> None:
    if not isinstance(model, FO.ForestModel):
        model.write().overwrite().save(path)
        return
    spark = SparkSession.active()
    FO.subtrees(spark, model).write.mode("overwrite").parquet(f"{path}/subtrees")
    model.scale.write().overwrite().save(f"{path}/scale")
    head = (model.labels, model.class_weights, model.cuts.tolist(), model.trees, model.depth)
    spark.createDataFrame([head], _FOREST).write.mode("overwrite").parquet(f"{path}/forest")


def load_model(path: str) -> PipelineModel | FO.ForestModel:
    try:
        head = SparkSession.active().read.schema(_FOREST).parquet(f"{path}/forest").first()
    except AnalysisException:
        return PipelineModel.load(path)
    return FO.ForestModel(list(head.labels), list(head.class_weights), StandardScalerModel.load(f"{path}/scale"), np.array(head.cuts), head.trees, head.depth, f"{path}/subtrees")


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Every test row predicted as the most frequent training label (ties: the smallest)."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l"))))
    return test.withColumn("prediction", top.scalar())


def impurity_importance(model: FO.ForestModel, names: Sequence[str], spark) -> DataFrame:
    values = FO.importances(spark, model)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, mdi_importance double")


def shuffled_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Per seed a random permutation of ``columns`` over the rows: ``(keys, seed, columns)``.

    Both the rows and the donors are ranked by a seeded digest, and equal ranks are joined.
    """
    out = None
    for seed in seeds:
        place = shuffled_rank(df.select(*keys), [], 2 * seed, *keys)
        donor = shuffled_rank(df.select(*keys, *columns), [], 2 * seed + 1, *keys).select("rank", *columns)
        one = place.join(donor, "rank").drop("rank").withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def shuffle_labels(df: DataFrame, keys: Sequence[str] = ("recording_id", "segment", "k"), seed: int = SEED) -> DataFrame:
    """``df`` with its labels permuted."""
    return df.drop("label").join(shuffled_by(df, keys, ["label"], [seed]).drop("seed"), list(keys))


def permutation_importance(model: FO.ForestModel, scored: DataFrame, names: Sequence[str], positive: str = FALL,
                           repeats: int = REPEATS, keys: Sequence[str] = ("recording_id", "segment", "k")) -> DataFrame:
    """Mean drop of the positive class's F1 when one feature is permuted.

    The repeats are scored in one job, or in several where their rows would fill the disk: a row meets its donor of each
    repeat once, and a task walks the forest's trees with each feature in turn taken from the donor (:mod:`gaitframe.operators.forest`), so no row is copied
    for a feature and only counts leave a task. ``scored`` has ``features`` and ``label`` (runs jobs).
    """
    rows = materialize(FO.binned(model.scale, model.cuts, scored, {**{k: F.col(k) for k in keys}, "label": F.col("label")}), "binned")
    place, cores = model.labels.index(positive) if positive in model.labels else -1, scored.sparkSession.sparkContext.defaultParallelism
    counts = None
    # a row is shuffled as a donor, with its donor and to the tasks of the walks
    for some in FO.portions(repeats, 4 * rows.count() * len(names)):
        donors = shuffled_by(rows.select(*keys, F.col("bins").alias("y")), keys, ["y"], [i + 1 for i in some])
        both = rows.join(donors, list(keys)).select(
            F.coalesce(F.col("label") == positive, F.lit(False)).alias("is_positive"), "seed", F.col("bins").alias("x"), "y")
        found = materialize(FO.permuted_counts(both.repartition(4 * cores), model, place), "permuted")
        counts = found if counts is None else counts.unionByName(found)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    base = M.safety(predict(model, scored), (), positive).select("fall_f1").scalar()
    drops = counts.groupBy(F.col("feature").alias("_f")).agg((base - F.avg(f1)).alias("fall_perm_importance"))
    listed = scored.sparkSession.createDataFrame(list(enumerate(names)), "_f int, feature string")
    return listed.join(drops, "_f", "left").select("feature", F.coalesce("fall_perm_importance", F.lit(0.0)).alias("fall_perm_importance"))


# Feature groups of the importance narrative, first match wins.
NARRATIVE = {
    "SVM / jerk": ["acc_svm", "gyr_svm", "acc_jerk", "gyr_jerk", "resultant"],
    "Spectral": ["band_high", "band_mid", "dom_freq", "spec_centroid", "spec_entropy"],
    "Statistical": ["az_kurt", "az_skew", "acc_sma", "az_std", "resultant_peak"],
}


def top_features(table: DataFrame, by: str, k: int = 20) -> DataFrame:
    return table.orderBy(F.desc(by), "feature").limit(k)


def importance_narrative(table: DataFrame, by: str = "fall_perm_importance", k: int = 5) -> DataFrame:
    """Group of each of the top ``k`` features; features of no group are left out."""
    group = None
    for name, parts in NARRATIVE.items():
        hit = F.col("feature").rlike("|".join(parts))
        group = F.when(hit, name) if group is None else group.when(hit, name)
    return top_features(table, by, k).select("feature", group.alias("group")).filter(F.col("group").isNotNull())


def _uniform(seed: int, *parts: Column) -> Column:
    """Repeatable uniform number in (0, 1) from the digest of its address."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**52)) + 0.5) / float(2**52)


def augment_windows(windows: DataFrame, seed: int = SEED, sigma: float = 0.02, low: float = 0.93, high: float = 1.07,
                    dropout: float = 0.05) -> DataFrame:
    """Noise on every value, one scale per channel, and now and then a silent channel.

    Random numbers are digests of (seed, window, sample, channel), so a retried task repeats them.
    """
    key = [F.col("recording_id"), F.col("segment"), F.col("k")]
    gains = {}
    for c in SENSORS:
        gain = low + (high - low) * _uniform(seed, *key, F.lit(c))
        gains[c] = F.when(_uniform(seed + 1, *key, F.lit(c)) > dropout, gain).otherwise(0.0)

    def noisy(s, c):
        radius = F.sqrt(-2.0 * F.log(_uniform(seed + 2, *key, s["at"], F.lit(c))))
        normal = radius * F.cos(6.283185307179586 * _uniform(seed + 3, *key, s["at"], F.lit(c)))
        return (s[c] + sigma * normal) * gains[c]

    return windows.withColumn("samples", F.transform("samples", lambda s: F.struct(
        s["at"].alias("at"), s["timestamp"].alias("timestamp"), *[noisy(s, c).alias(c) for c in SENSORS],
        s["label"].alias("label"))))


def on_device_gates(ticks: DataFrame, classes: Sequence[str] = tuple(VALID_LABELS), keys: Sequence[str] = ("recording_id",),
                    ts: str = "tick_ts", slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Final label per tick: resting posture from the third still tick in a row, walking for
    gentle motion on low power, else the model's ``model_label`` and ``model_probs``.

    ``ticks`` have ``stationary``, ``gentle``, ``posture``, ``low_power`` and ``tick``; ``gate``
    says which rule decided.
    """
    moved = F.when(~F.col("stationary"), F.col("tick"))
    rows = carry_forward(ticks, keys, [ts], {"_moved": moved}, time_slice(ts, slice_ms))
    still = F.col("tick") - F.coalesce("_moved", F.lit(-1))
    rows = rows.withColumn("still_ticks", F.when(F.col("stationary"), still).otherwise(0)).drop("_moved")
    gate = (F.when(F.col("still_ticks") > 2, "rest").when(F.col("low_power") & F.col("gentle"), "gentle").otherwise("model"))
    rows = rows.withColumn("gate", gate)

    def certain(label, p, rest):
        return F.array(*[F.when(label == c, p).otherwise(rest) for c in classes])

    names = F.array(*[F.lit(c) for c in classes])
    probs = (F.when(F.col("gate") == "rest", certain(F.col("posture"), 0.95, 0.01))
             .when(F.col("gate") == "gentle", certain(F.lit("walking"), 0.88, 0.02)).otherwise(F.col("model_probs")))
    return rows.withColumn("probabilities", probs).withColumns({
        "label": F.when(F.col("gate") == "model", F.col("model_label")).otherwise(C.arg_max("probabilities", names)),
        "confidence": F.array_max("probabilities")})
