"""Sliding sample windows, their labels, trailing ticks and snapshots.

Rows are copied to the windows they belong to (two with 100/50) and grouped by
(recording, segment, window). A window holds exactly ``size`` rows, so no group grows with the
data, and a recording of any length spreads over all tasks.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators.ordered import add_segments, ordered_position, time_slice
from gaitframe.schema import FALL, MIN_PURITY, SENSORS, SLICE_MS, WINDOW_SIZE, WINDOW_STEP

WINDOW_KEYS = ["recording_id", "segment", "k"]


def window_rows(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                pos: str = "pos") -> DataFrame:
    """One row per (sample, window): ``k`` is the window number, ``at`` the place inside it.

    Windows that the segment ends too early for are still partial here.
    """
    p = F.col(pos)
    first = F.greatest(F.lit(0), F.ceil((p - (size - 1)) / step))
    numbers = F.explode(F.sequence(first, F.floor(p / step)))
    rows = df.filter(F.floor(p / step) >= first).withColumn("k", numbers)
    return rows.withColumn("at", (p - F.col("k") * step).cast("int"))


def sample_windows(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                   keys: Sequence[str] = ("recording_id", "segment")) -> DataFrame:
    """Bounds of every complete window: first and last timestamp and number of rows."""
    return (
        window_rows(df, size, step).groupBy(*keys, "k")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("start_ts"),
             F.max("timestamp").alias("end_ts"))
        .filter(F.col("n_rows") == size))


def majority(labels: Column) -> Column:
    """Struct (label, purity) of an array of labels; ties go to the smallest label."""
    names = F.array_sort(F.array_distinct(labels))
    counts = F.transform(names, lambda u: F.size(F.filter(labels, lambda x: x == u)))
    best = F.array_max(counts)
    return F.struct(
        F.element_at(names, F.array_position(counts, best).cast("int")).alias("label"),
        (best / F.size(labels)).alias("purity"))


def collect_windows(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                    min_purity: float | None = MIN_PURITY,
                    keys: Sequence[str] = ("recording_id", "segment"),
                    carry: Sequence[str] = ("subject_id", "dataset_id")) -> DataFrame:
    """One row per kept window with its ``samples`` in order, label and purity.

    ``df`` has ``pos`` from :func:`add_segments`. The label is the majority label; any falling
    row makes the window a fall and keeps it; other windows need ``min_purity``.
    """
    sample = F.struct("at", "timestamp", *SENSORS, "label")
    windows = (
        window_rows(df, size, step).groupBy(*keys, "k")
        .agg(*[F.first(c).alias(c) for c in carry], F.count(F.lit(1)).alias("n_rows"),
             F.sort_array(F.collect_list(sample)).alias("samples"))
        .filter(F.col("n_rows") == size).drop("n_rows"))
    windows = windows.withColumn("_m", majority(F.col("samples.label")))
    has_fall = F.array_contains(F.col("samples.label"), FALL)
    windows = windows.select(
        *keys, "k", *carry, F.when(has_fall, FALL).otherwise(F.col("_m.label")).alias("label"),
        F.col("_m.purity").alias("purity"), has_fall.alias("has_fall"), "samples")
    if min_purity is None:
        return windows
    return windows.filter(F.col("has_fall") | (F.col("purity") >= min_purity))


def label_windows(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                  min_purity: float = MIN_PURITY,
                  keys: Sequence[str] = ("recording_id", "segment"),
                  carry: Sequence[str] = ("subject_id", "dataset_id")) -> DataFrame:
    """Labels of the windows without their samples.

    Counted per (window, label) first, so the shuffle carries a few rows per window.
    """
    counts = window_rows(df, size, step).groupBy(*keys, "k", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start_ts"),
        *[F.first(c).alias(c) for c in carry])
    top = F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l")))
    windows = counts.groupBy(*keys, "k").agg(
        F.sum("n").alias("n_rows"), F.min("start_ts").alias("start_ts"),
        *[F.first(c).alias(c) for c in carry], top.alias("_top"),
        (F.max("n") / F.sum("n")).alias("purity"),
        F.bool_or(F.col("label") == FALL).alias("has_fall"))
    return (
        windows.filter(F.col("n_rows") == size)
        .withColumn("label", F.when(F.col("has_fall"), FALL).otherwise(F.col("_top")))
        .filter(F.col("has_fall") | (F.col("purity") >= min_purity)).drop("_top", "n_rows"))


def explode_windows(windows: DataFrame) -> DataFrame:
    """Back from window arrays to one row per sample; keeps the window's label as ``label``.

    Of a plain explode Spark infers a filter on the size of the array and moves it below the columns that the array is made
    of: a change of samples by the window's label would work out the label anew for every sample. Outer generators have none.
    """
    other = [c for c in windows.columns if c != "samples"]
    return windows.select(*other, F.posexplode_outer("samples").alias("_nth", "s")).filter(F.col("_nth").isNotNull()).select(
        *other, F.col("s.at").alias("at"), F.col("s.timestamp").alias("timestamp"),
        *[F.col(f"s.{c}").alias(c) for c in SENSORS])


def latest_n(df: DataFrame, n: int = WINDOW_SIZE, keys: Sequence[str] = ("recording_id",),
             ts: str = "timestamp") -> DataFrame:
    """Latest ``n`` rows of every key, oldest first (``at`` from 0); keys with fewer give none.

    Spark cuts every map task to ``n`` rows per key before the shuffle (window group limit).
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_back", F.row_number().over(w.orderBy(F.desc(ts)))).filter(F.col("_back") <= n)
    return (
        ranked.withColumn("_have", F.max("_back").over(w)).filter(F.col("_have") == n)
        .withColumn("at", n - F.col("_back")).drop("_back", "_have"))


def peak_windows(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                 keys: Sequence[str] = ("recording_id",), slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Windows of fall recordings labelled by their distance from the impact.

    Centre within half a window of the recording's strongest sample: falling; more than a whole
    window later: lying; others are dropped. The peak of a recording is an aggregate, so no row
    is moved for it beyond one per recording and map task.
    """
    keys = list(keys)
    rows = ordered_position(df, keys, ["timestamp"], time_slice("timestamp", slice_ms))
    svm = C.acc_magnitude()
    peaks = rows.groupBy(*keys).agg(
        F.min_by("pos", F.struct((-svm).alias("s"), F.col("pos").alias("p"))).alias("peak_pos"))
    whole = window_rows(rows, size, step).groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("start_ts")
    ).filter(F.col("n_rows") == size)
    centre = F.col("k") * step + size // 2
    off = centre - F.col("peak_pos")
    label = F.when(F.abs(off) <= size // 2, FALL).when(off > size, "lying")
    return (whole.join(peaks, keys).withColumn("label", label).filter(F.col("label").isNotNull())
            .drop("n_rows"))


def inference_ticks(df: DataFrame, every_ms: int = 400, size: int = WINDOW_SIZE,
                    sample_ms: int = 20, keys: Sequence[str] = ("recording_id",),
                    extra: Sequence[Column] = (), slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Trailing windows at a fixed tick: the latest ``size`` rows every ``every_ms``.

    Like the device's ring buffer, a tick looks back over pauses. ``extra`` are further
    aggregates over the rows of the window (``at`` is the place inside it).
    """
    rows = ordered_position(df, keys, ["timestamp"], time_slice("timestamp", slice_ms))
    return (
        window_rows(rows, size, every_ms // sample_ms).groupBy(*keys, F.col("k").alias("tick"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("tick_ts"), *extra)
        .filter(F.col("n_rows") == size).drop("n_rows"))


def window_summary(windows: DataFrame) -> DataFrame:
    """Windows and subjects per label; subjects are reduced per label before they are counted."""
    return (
        windows.groupBy("label", "subject_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("label").agg(F.sum("n").alias("n_windows"), F.count(F.lit(1)).alias("n_subjects")))


def cap_recordings(df: DataFrame, limit: int = 12, subject: str = "subject_id",
                   name: str = "recording_id", fall_label: str = "label") -> DataFrame:
    """The first ``limit`` fall and the first ``limit`` other recordings of every subject, by name.

    Ranks the list of recordings (one row each); a recording is a fall recording when it has a
    falling row. The cap is the feature; pass another ``limit`` for more.
    """
    files = df.groupBy(subject, name).agg(F.bool_or(F.col(fall_label) == FALL).alias("is_fall_file"))
    rank = F.row_number().over(Window.partitionBy(subject, "is_fall_file").orderBy(name))
    kept = files.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")
    return df.join(kept, [subject, name])


def segmented(df: DataFrame, **options) -> DataFrame:
    """Shorthand for :func:`add_segments` without the ``segment`` column of the source."""
    return add_segments(df.drop("segment"), **options)
