"""Dataset, class, subject, sensor and position reports.

Counts start from one reduction of the samples (:func:`profile`), so the samples are shuffled
once, after map-side combining, and distinct counts run over its few rows.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.operators.ordered import exact_quantiles
from gaitframe.schema import ACC, GYR, SENSORS, TARGET_HZ


def profile(df: DataFrame, *extra: str) -> DataFrame:
    """Rows per (dataset, subject, recording, label, position, has_gyro, ...)."""
    return df.groupBy("dataset_id", "subject_id", "recording_id", "unified_label", "phone_position",
                      "has_gyro", *extra).agg(F.count(F.lit(1)).alias("n"), F.count("ax").alias("n_ax"))


def _distinct(**names):
    return [F.countDistinct(c).alias(n) for n, c in names.items()]


def dataset_summary(df: DataFrame) -> DataFrame:
    rows = F.sum("n")
    return profile(df).groupBy("dataset_id").agg(
        rows.alias("n_rows"),
        *_distinct(n_subjects="subject_id", n_recordings="recording_id", n_unique_labels="unified_label"),
        F.bround(rows / TARGET_HZ / 60, 1).alias("est_duration_min"),
        F.bround(F.sum(F.when(F.col("has_gyro"), F.col("n")).otherwise(0)) / rows * 100, 1).alias("has_gyro_pct"))


def class_distribution(df: DataFrame) -> DataFrame:
    return profile(df).groupBy("unified_label", "dataset_id", "phone_position").agg(
        F.sum("n_ax").alias("n_rows"), *_distinct(n_subjects="subject_id", n_recordings="recording_id"))


def subject_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("subject_id", "unified_label").agg(F.count("ax").alias("n_rows"))


def unpivot_sensors(df: DataFrame, channels: Sequence[str] = tuple(SENSORS)) -> DataFrame:
    return df.unpivot(["dataset_id"], list(channels), "channel", "value").filter(F.col("value").isNotNull())


def sensor_statistics(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, range and exact 5 % and 95 % quantiles per dataset and channel."""
    wide = df.groupBy("dataset_id").agg(*[
        F.struct(F.lit(c).alias("channel"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in SENSORS])
    stats = wide.select("dataset_id", F.inline(F.array(*SENSORS))).filter(F.col("mean").isNotNull())
    quantiles = exact_quantiles(unpivot_sensors(df), ["dataset_id", "channel"], "value",
                                {"pct5": 0.05, "pct95": 0.95})
    names = ["mean", "std", "min", "max", "pct5", "pct95"]
    return stats.join(quantiles, ["dataset_id", "channel"]).select(
        "dataset_id", "channel", *[F.round(c, 4).alias(c) for c in names])


def position_distribution(df: DataFrame) -> DataFrame:
    return profile(df).groupBy("phone_position").agg(
        F.sum("n_ax").alias("n_rows"),
        *_distinct(n_subjects="subject_id", n_recordings="recording_id", n_datasets="dataset_id"),
    ).orderBy(F.desc("n_rows"), "phone_position")


def balance_overview(df: DataFrame) -> DataFrame:
    counts = df.groupBy("unified_label").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share_pct", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()) * 100)


def diversity_summary(df: DataFrame) -> DataFrame:
    """One totals row (label ``*``) and one row per label."""
    base = profile(df, "age_group")
    measures = [F.sum("n").alias("n_rows"), *_distinct(n_subjects="subject_id", n_recordings="recording_id"),
                F.sum(F.when(F.col("has_gyro"), F.col("n")).otherwise(0)).alias("gyro_rows"),
                F.array_join(F.sort_array(F.collect_set("age_group")), ",").alias("age_groups"),
                F.array_join(F.sort_array(F.collect_set("phone_position")), ",").alias("positions")]
    return (base.groupBy("unified_label").agg(*measures)
            .unionByName(base.groupBy(F.lit("*").alias("unified_label")).agg(*measures)))


def load_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "subject_id").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"))


def class_weights(df: DataFrame, label: str = "label", floor: float = 0.1) -> DataFrame:
    """Inverse-frequency weights with mean 1; no weight below ``floor`` times the largest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    inverse = counts.withColumn("_w", F.sum("n").over(every) / F.col("n"))
    scaled = inverse.withColumn("_w", F.col("_w") / F.sum("_w").over(every) * F.count(F.lit(1)).over(every))
    return scaled.select(label, F.greatest(F.col("_w"), F.lit(floor) * F.max("_w").over(every)).alias("weight"))


def class_weight_array(df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """One row with ``weights`` in the order of ``classes``; 1.0 for a class without rows."""
    known = class_weights(df, label).agg(
        F.map_from_entries(F.collect_list(F.struct(label, "weight"))).alias("_w"))
    return known.select(F.array(*[
        F.coalesce(F.try_element_at("_w", F.lit(c)), F.lit(1.0)) for c in classes]).alias("weights"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.select(label, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def class_by_dataset(df: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Rows per label and dataset as a wide table (without ``datasets`` Spark lists them first)."""
    return df.groupBy("unified_label").pivot("dataset_id", datasets and list(datasets)).count().na.fill(0)


def subjects_by_dataset(df: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    pairs = df.select("unified_label", "dataset_id", "subject_id").distinct()
    return pairs.groupBy("unified_label").pivot("dataset_id", datasets and list(datasets)).count().na.fill(0)


def sensor_ranges(df: DataFrame) -> DataFrame:
    """Box-plot numbers per dataset and sensor kind; whiskers reach the last value within 1.5 IQR."""
    kind = F.when(F.col("channel").isin(ACC), "accelerometer").when(F.col("channel").isin(GYR), "gyroscope")
    values = unpivot_sensors(df).select("dataset_id", kind.alias("kind"), "value")
    keys = ["dataset_id", "kind"]
    boxes = exact_quantiles(values, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return values.join(boxes, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count(F.lit(1)).alias("n_values"))


def recording_durations(df: DataFrame) -> DataFrame:
    return df.groupBy("recording_id").agg((F.count(F.lit(1)) / TARGET_HZ / 60).alias("minutes"))


def median_duration(df: DataFrame) -> DataFrame:
    return exact_quantiles(recording_durations(df), [], "minutes", {"median_minutes": 0.5}, width=1 / 1024)


def duration_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width bins from the shortest to the longest recording, empty bins included."""
    durations = recording_durations(df)
    ends = durations.agg(F.struct(F.min("minutes").alias("lo"), F.max("minutes").alias("hi"))).scalar()
    placed = durations.withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    flat = F.when(lo == hi, F.lit(bins // 2 + 1))
    number = flat.otherwise(F.least(F.lit(bins), F.floor((F.col("minutes") - lo) / (hi - lo) * bins) + 1))
    # the ends ride along with the counts, so the recordings are counted once more for them only
    counts = placed.groupBy(number.cast("long").alias("bin"), "_e").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy().agg(
        F.first("_e").alias("_e"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    rows = edges.select("_e", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    left = F.when(lo == hi, lo - 0.5).otherwise(lo)
    width = F.when(lo == hi, 1.0).otherwise(hi - lo) / bins
    return rows.select(
        "bin", (left + (F.col("bin") - 1) * width).alias("from_minutes"), (left + F.col("bin") * width).alias("to_minutes"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).alias("n_recordings"))


def position_counts(df: DataFrame) -> DataFrame:
    return profile(df).groupBy("phone_position").agg(
        F.sum("n_ax").alias("n_rows"), F.countDistinct("subject_id").alias("n_subjects")
    ).orderBy("n_rows", "phone_position")


def split_statistics(df: DataFrame) -> DataFrame:
    """Rows, subjects, recordings and datasets per ``split``."""
    base = df.groupBy("split", "dataset_id", "subject_id", "recording_id").agg(F.count(F.lit(1)).alias("n"))
    return base.groupBy("split").agg(
        F.sum("n").alias("n_rows"), *_distinct(n_subjects="subject_id", n_recordings="recording_id"),
        F.array_join(F.sort_array(F.collect_set("dataset_id")), ",").alias("datasets"))
