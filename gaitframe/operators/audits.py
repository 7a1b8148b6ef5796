"""Leakage, duplicate, metadata and stress audits."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.operators import joins as J
from gaitframe.schema import BASE_TIMESTAMP_MS, FALL, SENSORS, WINDOW_SIZE, WINDOW_STEP

# Name parts that must not occur in a feature name.
FORBIDDEN_TOKENS = ["time", "timestamp", "subject", "subject_id", "id", "row", "row_id", "index", "segment",
                    "session", "date", "file", "filename", "dataset", "dataset_id"]
TILT_DEGREES = 25.0
SPEED_FACTORS = (1.3, 0.7)
SLUMP_FACTOR = 0.55


def split_audit(df: DataFrame) -> DataFrame:
    """Subjects per part, subjects in two parts, and recordings crossing parts, in one row."""
    parts = ["train", "validation", "test"]

    def crossing(key):
        flags = df.groupBy(key).agg(*[F.bool_or(F.col("split") == p).cast("long").alias(p) for p in parts])
        return flags

    who, what = crossing("subject_id"), crossing("recording_id")
    a, b, c = (F.col(p) for p in parts)
    left = who.agg(*[F.sum(p).alias(f"n_{p}") for p in parts], F.sum(a * b).alias("train_validation"),
                   F.sum(a * c).alias("train_test"), F.sum(b * c).alias("validation_test"))
    right = what.agg(F.sum((a + b + c > 1).cast("long")).alias("recordings_crossing"))
    return left.select("*", right.scalar().alias("recordings_crossing"))


def windowing_audit(before: DataFrame, after: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP) -> DataFrame:
    """Window counts of the two orders of splitting and windowing, and test windows that share samples with training.

    ``before`` are windows cut inside each part, ``after`` windows cut first and then assigned; both have
    ``split``. Windows k and k' of a segment share samples when ``|k - k'| * step < size``, so no sample is read.
    """
    def counts(df, name):
        return df.agg(*[F.count(F.when(F.col("split") == p, 1)).alias(f"{name}_{p}") for p in ("train", "test")])

    reach = (size - 1) // step
    near = F.explode(F.array(*[F.col("k") + d for d in range(-reach, reach + 1) if d]))
    keys = ["recording_id", "segment", "k"]
    touched = after.filter("split = 'train'").select("recording_id", "segment", near.alias("k")).distinct()
    leaked = after.filter("split = 'test'").select(*keys).join(touched, keys, "left_semi").agg(F.count(F.lit(1)).alias("overlapping_test_windows"))
    crossing = after.groupBy("recording_id").agg(F.countDistinct("split").alias("n")).agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("recordings_crossing"))
    one = F.lit(1)
    out = leaked.withColumn("_", one)
    for part in (counts(before, "before"), counts(after, "after"), crossing):
        out = out.join(part.withColumn("_", one), "_")
    return out.drop("_")


def duplicate_audit(train: DataFrame, test: DataFrame, n: int = 200, threshold: float = 0.01, seed: int = 42) -> DataFrame:
    near = J.near_duplicates(train, test, n, threshold, seed)
    exact = J.exact_duplicates(train, test).agg(F.count(F.lit(1)))
    return near.agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count_if("near_duplicate").alias("near_duplicates"),
        (F.avg(F.col("near_duplicate").cast("double")) * 100).alias("pct_near_duplicates"),
        F.avg("min_distance").alias("mean_min_distance"), F.stddev_pop("min_distance").alias("std_min_distance"),
    ).withColumn("exact_duplicates", exact.scalar())


def suspicious_names(df: DataFrame, name: str = "feature") -> DataFrame:
    tokens = F.split(F.lower(F.col(name)), "_")
    forbidden = F.array(*[F.lit(t) for t in FORBIDDEN_TOKENS])
    return df.withColumn("suspicious", F.arrays_overlap(tokens, forbidden))


def label_correlations(df: DataFrame, cols: Sequence[str] = ("timestamp", *SENSORS), label: str = "label") -> DataFrame:
    """Pearson correlation of raw columns with the alphabetical label code; NULL if constant.

    The code table has one row per label.
    """
    codes = df.select(label).distinct().withColumn("_code", F.row_number().over(Window.orderBy(label)) - 1)
    rows = df.select(label, *cols).join(codes, label)
    code = F.col("_code").cast("double")

    def corr(c):
        # clock values are shifted near zero first: correlation is unchanged and keeps its digits
        x = (F.col(c) - (BASE_TIMESTAMP_MS if c == "timestamp" else 0)).cast("double")
        both = F.when(x.isNotNull(), code)
        varied = (F.min(x) < F.max(x)) & (F.min(both) < F.max(both))
        return F.when(varied, F.try_divide(F.covar_pop(x, both), F.stddev_pop(x) * F.stddev_pop(both)))

    wide = rows.agg(*[corr(c).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "correlation")


def _with_samples(windows: DataFrame, values: dict[str, callable]) -> DataFrame:
    sample = lambda s: F.struct(*[values.get(c, lambda v, c=c: v[c])(s).alias(c)
                                  for c in ("at", "timestamp", *SENSORS, "label")])
    return windows.withColumn("samples", F.transform("samples", sample))


def tilt_windows(windows: DataFrame, degrees: float = TILT_DEGREES) -> DataFrame:
    """Acceleration turned in the x-y plane."""
    cos, sin = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return _with_samples(windows, {"ax": lambda s: s["ax"] * cos - s["ay"] * sin,
                                   "ay": lambda s: s["ax"] * sin + s["ay"] * cos})


def slump_windows(windows: DataFrame, factor: float = SLUMP_FACTOR) -> DataFrame:
    """Weaker impacts: acceleration of fall windows scaled down."""
    f = F.when(F.col("label") == FALL, F.lit(factor)).otherwise(1.0)
    return _with_samples(windows, {c: (lambda s, c=c: s[c] * f) for c in ("ax", "ay", "az")})


def speed_windows(windows: DataFrame, factors: tuple[float, float] = SPEED_FACTORS) -> DataFrame:
    """Walking and running windows played faster (even windows) or slower (odd ones).

    Sample ``i`` becomes the linear blend at position ``i * factor``; the last sample is held.
    """
    factor = F.when(F.col("k") % 2 == 0, F.lit(factors[0])).otherwise(F.lit(factors[1]))
    last = F.size("samples") - 1

    def resampled(s):
        p = F.least(s["at"] * factor, last.cast("double"))
        lo, hi = F.get("samples", F.floor(p).cast("int")), F.get("samples", F.ceil(p).cast("int"))
        share = p - F.floor(p)
        return F.struct(s["at"].alias("at"), s["timestamp"].alias("timestamp"),
                        *[(lo[c] + (hi[c] - lo[c]) * share).alias(c) for c in SENSORS], s["label"].alias("label"))

    moving = F.col("label").isin("walking", "running")
    return windows.withColumn("samples", F.when(moving, F.transform("samples", resampled)).otherwise(F.col("samples")))


STRESSES = {
    "Clean Baseline": lambda w: w,
    "Orientation 25° Tilt": tilt_windows,
    "Gait Speed Shift (±30%)": speed_windows,
    "Atypical / Slump Falls (-45% impact)": slump_windows,
}

