"""Coercion, filtering, unit conversion, resampling and gap filling of sensor samples."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators.ordered import carry_forward, ordered_position, time_slice
from gaitframe.schema import (ACC, ACC_BOUND, BASE_TIMESTAMP_MS,
                              CANONICAL_SCHEMA, GYR, GYR_BOUND, SAMPLE_MS, SENSORS, SLICE_MS,
                              TRAINABLE_LABELS, VALID_LABELS)


def coerce_numeric(df: DataFrame, cols: Sequence[str], type_name: str = "double") -> DataFrame:
    """Cast to a number; text that is not a number becomes NULL."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast(type_name) for c in cols})


def clean_labels(df: DataFrame, valid: Sequence[str] = tuple(VALID_LABELS),
                 label: str = "label") -> DataFrame:
    text = F.lower(F.trim(F.col(label).cast("string")))
    return df.withColumn(label, text).filter(F.col(label).isin(list(valid)))


def drop_out_of_range(df: DataFrame, acc_bound: float = ACC_BOUND,
                      gyr_bound: float = GYR_BOUND) -> DataFrame:
    """Drop rows with any channel beyond its physical bound; NULL channels pass."""
    beyond = [F.coalesce(F.abs(c) > acc_bound, F.lit(False)) for c in ACC]
    beyond += [F.coalesce(F.abs(c) > gyr_bound, F.lit(False)) for c in GYR]
    return df.filter(~reduce(or_, beyond))


def drop_missing(df: DataFrame, cols: Sequence[str] = tuple(SENSORS)) -> DataFrame:
    return df.na.drop(subset=list(cols))


def to_si(df: DataFrame, acc_unit: str = "m/s2", gyr_unit: str = "rad/s") -> DataFrame:
    """Convert the channels to m/s² and rad/s from g, ADC counts or deg/s."""
    acc = {"m/s2": F.col, "g": C.g_to_si, "adc": lambda c: C.from_adc(c, C.ADC_ACC_SCALE)}[acc_unit]
    gyr = {"rad/s": F.col, "deg/s": C.deg_to_rad,
           "adc": lambda c: C.from_adc(c, C.ADC_GYR_SCALE)}[gyr_unit]
    return df.withColumns({**{c: acc(c) for c in ACC}, **{c: gyr(c) for c in GYR}})


def decimate(df: DataFrame, every: int, keys: Sequence[str] = ("recording_id",),
             order: Sequence[str] = ("timestamp",), slice_by: Column | None = None,
             average: bool = False) -> DataFrame:
    """Every ``every``-th row of a recording, the first included; ``average=True`` takes the mean
    of the channels over each run of ``every`` rows instead."""
    rows = ordered_position(df, keys, list(order),
                            time_slice(order[0]) if slice_by is None else slice_by, out="_nth")
    return (average_runs(rows, every, keys) if average else rows.filter(F.col("_nth") % every == 0)).select(*df.columns)


def average_runs(rows: DataFrame, every: int, keys: Sequence[str], nth: str = "_nth") -> DataFrame:
    """Mean of the channels over each run of ``every`` rows; other columns from its first row."""
    first = [c for c in rows.columns if c not in SENSORS and c not in keys]
    return (
        rows.withColumn("_run", F.floor(F.col(nth) / every)).groupBy(*keys, "_run")
        .agg(*[F.min_by(c, nth).alias(c) for c in first], *[F.avg(c).alias(c) for c in SENSORS])
        .select(*rows.columns))


def synth_timestamps(df: DataFrame, rate_hz: int, keys: Sequence[str] = ("recording_id",),
                     order: Sequence[str] = ("line_no",), slice_by: Column | None = None,
                     base_ms: int = BASE_TIMESTAMP_MS) -> DataFrame:
    """Timestamps from the row number: ``base + i * (1000 div rate)``."""
    rows = ordered_position(df, keys, list(order),
                            time_slice(order[0]) if slice_by is None else slice_by, out="_nth")
    step = 1000 // rate_hz
    return rows.withColumn("timestamp", (F.lit(base_ms) + F.col("_nth") * step).cast("long")).drop("_nth")


def conform(df: DataFrame) -> DataFrame:
    """Canonical columns in canonical order and type; missing ones become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CANONICAL_SCHEMA.fields])


def add_gyro_flag(df: DataFrame) -> DataFrame:
    """``has_gyro`` from the first gyroscope channel, then zeros for missing gyroscope values."""
    return df.withColumn("has_gyro", F.col("gx").isNotNull()).na.fill(0.0, subset=GYR)


def add_age_group(df: DataFrame, subject: str = "subject_id") -> DataFrame:
    return df.withColumn("age_group", C.age_group(subject))


def keep_trainable(df: DataFrame, label: str = "unified_label") -> DataFrame:
    return df.filter(F.col(label).isin(TRAINABLE_LABELS))


def interpolate(df: DataFrame, limit: int = 3, cols: Sequence[str] = tuple(SENSORS),
                keys: Sequence[str] = ("recording_id",), ts: str = "timestamp",
                slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Fill gaps by the row-number line between the neighbours, at most ``limit`` rows from a
    valid one on either side; before the first and after the last valid row its value is held."""
    rows = ordered_position(df, keys, [ts], time_slice(ts, slice_ms), out="_row")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("r"), F.col(c).alias("v")))
             for c in cols}
    rows = carry_forward(rows, keys, [ts], {f"_p_{c}": x for c, x in known.items()},
                         time_slice(ts, slice_ms))
    rows = carry_forward(rows, keys, [ts], {f"_n_{c}": x for c, x in known.items()},
                         time_slice(ts, slice_ms), descending=True)
    filled = {}
    for c in cols:
        before, after, r = F.col(f"_p_{c}"), F.col(f"_n_{c}"), F.col("_row")
        near = (r - before["r"] <= limit) | (after["r"] - r <= limit)
        line = before["v"] + (after["v"] - before["v"]) * (r - before["r"]) / (after["r"] - before["r"])
        value = (F.when(before.isNull(), after["v"]).when(after.isNull(), before["v"]).otherwise(line))
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(near, value)
    return rows.withColumns(filled).select(*df.columns)


def with_report_defaults(df: DataFrame) -> DataFrame:
    """Columns the reports need, with their defaults where the frame lacks them."""
    have = set(df.columns)
    add = {}
    if "dataset_id" not in have:
        add["dataset_id"] = F.lit("synthetic")
    subject = F.col("subject_id") if "subject_id" in have else (
        F.col("subject") if "subject" in have else F.lit("unknown"))
    if "subject_id" not in have:
        add["subject_id"] = subject
    if "recording_id" not in have:
        add["recording_id"] = F.concat(subject.cast("string"), F.lit("_s0"))
    if "unified_label" not in have:
        add["unified_label"] = F.col("label") if "label" in have else F.lit("unknown")
    if "phone_position" not in have:
        add["phone_position"] = F.lit("unknown")
    if "has_gyro" not in have:
        add["has_gyro"] = F.col("gx").isNotNull() if "gx" in have else F.lit(True)
    return df.withColumns(add) if add else df


def with_window_defaults(df: DataFrame) -> DataFrame:
    """Columns the windows need: subject, label, segment 0, and 20 ms timestamps if there are none.

    Timestamps are numbered inside a recording in the order of ``line_no``.
    """
    have = set(df.columns)
    if "subject_id" not in have:
        df = df.withColumn("subject_id", F.col("subject") if "subject" in have else F.lit("unknown"))
    if "recording_id" not in have:
        df = df.withColumn("recording_id", F.concat(F.col("subject_id"), F.lit("_s0")))
    if "label" not in have:
        df = df.withColumn("label", F.col("unified_label") if "unified_label" in have else F.lit("unknown"))
    if "segment" not in have:
        df = df.withColumn("segment", F.lit(0))
    if "timestamp" not in have:
        df = synth_timestamps(df, 1000 // SAMPLE_MS, base_ms=0)
    return df


def sort_samples(df: DataFrame, keys: Sequence[str] = ("subject_id", "timestamp"),
                 total_order: bool = False) -> DataFrame:
    """Sort by subject and time: a total order on request, else within partitions."""
    return df.orderBy(*keys) if total_order else df.sortWithinPartitions(*keys)

