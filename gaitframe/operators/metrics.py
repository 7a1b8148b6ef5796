"""Classification and fall-safety metrics.

A scored frame has ``label`` and ``prediction``. It is reduced once to confusion counts, which
hold at most classes² rows per group; everything else works on those.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.schema import FALL

FALL_RECALL_TARGET = 0.90


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_table(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Long form over all pairs of ``classes`` with counts and row shares."""
    pairs = scored.sparkSession.createDataFrame(
        [(t, p) for t in classes for p in classes], "label string, prediction string")
    full = pairs.join(confusion(scored), ["label", "prediction"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("label"))
    return full.withColumn("row_share", _ratio(F.col("n"), total))


def confusion_wide(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    return (confusion_table(scored, classes).groupBy("label").pivot("prediction", list(classes))
            .agg(F.sum("n")))


def class_counts(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True, predicted and hit counts of every class that occurs as truth or prediction."""
    zero, n = F.lit(0).cast("long"), F.col("n")
    as_true = F.struct(F.col("label").alias("class"), n.alias("support"), zero.alias("predicted"),
                       F.when(F.col("label") == F.col("prediction"), n).otherwise(0).alias("hits"))
    as_pred = F.struct(F.col("prediction").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("hits"))
    return conf.select(*by, F.inline(F.array(as_true, as_pred))).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))


def with_scores(counts: DataFrame) -> DataFrame:
    df = counts.withColumns({"precision": _ratio(F.col("hits"), F.col("predicted")),
                             "recall": _ratio(F.col("hits"), F.col("support"))})
    return df.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def per_class(scored: DataFrame, classes: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a given class list fixes the rows."""
    counts = class_counts(confusion(scored, by), by)
    if classes is not None:
        listed = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
        wanted = (counts.select(*by).distinct().select(*by, listed) if by else
                  scored.sparkSession.range(1).select(listed))
        counts = wanted.join(counts, [*by, "class"], "left").na.fill(0, ["support", "predicted", "hits"])
    return with_scores(counts).drop("predicted", "hits")


def evaluate(scored: DataFrame, by: Sequence[str] = (), positive: str = FALL,
             classes: Sequence[str] | None = None) -> DataFrame:
    """Overall and safety metrics in one row per group, with the fall-recall verdict.

    One pass over the scored rows: the counts of the positive class give the safety metrics (a
    false alarm is a predicted row that is no hit). With ``classes``, ``macro_precision`` and
    ``macro_recall`` average over all of them, absent ones counting 0. Rates are 0 where a
    denominator is empty.
    """
    scores = with_scores(class_counts(confusion(scored, by), by))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")

    def of_positive(value):
        return F.sum(F.when(F.col("class") == positive, value).otherwise(0))

    macro = [] if classes is None else [
        (F.sum(F.when(F.col("class").isin(list(classes)), F.col(c))) / len(classes)).alias(f"macro_{c}")
        for c in ("precision", "recall")]
    df = scores.groupBy(*by).agg(
        (F.sum(hits) / F.sum(support)).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * support) / F.sum(support)).alias("weighted_f1"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"), *macro,
        of_positive(hits).alias("tp"), of_positive(support - hits).alias("fn"), of_positive(predicted - hits).alias("fp"),
        F.sum(support).alias("_n"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    df = df.withColumn("tn", F.col("_n") - tp - fn - fp).drop("_n").withColumns({
        "fall_recall": _ratio(tp, tp + fn), "fall_precision": _ratio(tp, tp + fp),
        "specificity": _ratio(tn, tn + fp), "fpr": _ratio(fp, tn + fp), "fnr": _ratio(fn, tp + fn)})
    return df.withColumn("fall_f1", _f1(F.col("fall_precision"), F.col("fall_recall"))).withColumn(
        "below_recall_target", F.col("fall_recall") < FALL_RECALL_TARGET)


def overall(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted F1 and balanced accuracy per group."""
    return evaluate(scored, by).select(*by, "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")


def safety(scored: DataFrame, by: Sequence[str] = (), positive: str = FALL) -> DataFrame:
    """Counts and rates of the fall class against the rest."""
    return evaluate(scored, by, positive).select(
        *by, "tp", "fn", "fp", "tn", "fall_recall", "fall_precision", "specificity", "fpr", "fnr", "fall_f1")


def fall_report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return safety(scored, by).select(
        *by, "fall_precision", "fall_recall", "fall_f1",
        (F.col("fall_recall") < FALL_RECALL_TARGET).alias("below_target"))


def comparison(results: dict[str, DataFrame]) -> DataFrame:
    """One row per model from scored frames."""
    out = None
    for name, scored in results.items():
        row = evaluate(scored).select(F.lit(name).alias("model"), "accuracy", "macro_f1", "fall_recall", "fall_f1")
        out = row if out is None else out.unionByName(row)
    return out


def cv_folds(scored: DataFrame) -> DataFrame:
    """Per (model, fold): train and validation accuracy and their gap, validation F1 and recall.

    ``scored`` has ``model``, ``fold`` and ``part`` (train or val).
    """
    m = evaluate(scored, ["model", "fold", "part"])
    val, train = F.col("part") == "val", F.col("part") == "train"

    def of(cond, c):
        return F.max(F.when(cond, F.col(c)))

    return m.groupBy("model", "fold").agg(
        of(train, "accuracy").alias("train_acc"), of(val, "accuracy").alias("val_acc"),
        (of(train, "accuracy") - of(val, "accuracy")).alias("gap"), of(val, "macro_f1").alias("macro_f1"),
        of(val, "fall_recall").alias("fall_recall"), of(val, "fall_f1").alias("fall_f1"))


def cv_summary(folds: DataFrame) -> DataFrame:
    names = ["train_acc", "val_acc", "gap", "macro_f1", "fall_recall", "fall_f1"]
    return folds.groupBy("model").agg(*[
        f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def diagnose(df: DataFrame, train: str, test: str, signed: bool) -> DataFrame:
    """Fit verdicts: cross-validation looks at the signed gap, the holdout at its size."""
    gap = F.col(train) - F.col(test)
    small = (gap if signed else F.abs(gap)) < 0.05
    good = F.col(train) >= 0.80
    return df.withColumns({
        "generalization_gap": gap, "underfitting": ~good, "overfitting": ~small,
        "target_met": F.col(test) >= 0.80,
        "overall": F.when(good & small, "OPTIMAL FIT").otherwise("NEEDS TUNING")})


def loso_table(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Metrics per held-out subject (``fold``). Macro precision and recall average over all
    ``classes``, absent ones counting 0; macro F1 over the classes present in the fold."""
    return evaluate(scored, ["fold"], classes=classes).select(
        "fold", "accuracy", F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"),
        F.col("macro_f1").alias("f1"), "fall_recall", "fall_precision", "fpr")


def loso_summary(table: DataFrame) -> DataFrame:
    names = ["accuracy", "precision", "recall", "f1", "fall_recall", "fall_precision", "fpr"]
    return table.agg(*[f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def best_model(results: DataFrame) -> DataFrame:
    """The model with the highest fall recall, then macro F1."""
    return results.orderBy(F.desc("fall_recall"), F.desc("macro_f1"), "model").limit(1)
