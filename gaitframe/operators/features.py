"""The 134 features of a sample window and the on-device window metrics.

All features come from one vectorised pass over Arrow batches: array lambdas inside the JVM are interpreted
element by element and took several times as long. The window arrays are already grouped, so features add no
shuffle.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.functions.spectrum import SPECTRAL, spectrum, spectrum_udf
from gaitframe.schema import ACC, GYR, SENSORS

# Feature names in the order of the feature vector.
TIME_DOMAIN = ["mean", "std", "min", "max", "range", "rms", "peak2peak", "zcr", "mad", "skew",
               "kurt", "iqr"]
AXIS_PAIRS = [*combinations(ACC, 2), *combinations(GYR, 2)]
MOTION = ["acc_svm_mean", "acc_svm_std", "acc_svm_peak", "gyr_svm_mean", "gyr_svm_std",
          "gyr_svm_peak", "acc_jerk_mean", "acc_jerk_peak", "gyr_jerk_mean", "gyr_jerk_peak",
          "resultant_mean", "resultant_peak"]

#: A sample this close to the window's mean is on it: the rest is rounding of the mean, which
#: depends on the order of summation.
AT_MEAN = 1e-9

#: Windows whose features a task computes at a time: the arrays in between take some ten times the samples.
BLOCK = 256


def feature_names() -> list[str]:
    names = [f"{c}_{s}" for c in SENSORS for s in TIME_DOMAIN]
    names += ["acc_sma", "gyr_sma"] + [f"corr_{a}_{b}" for a, b in AXIS_PAIRS]
    names += [f"{c}_{s}" for c in SENSORS for s in SPECTRAL]
    return names + MOTION


def _statistics(x: np.ndarray) -> list[np.ndarray]:
    """The time-domain features of (windows, channels, samples), each (windows, channels)."""
    mean, low, high = x.mean(-1), x.min(-1), x.max(-1)
    d = x - mean[..., None]
    m2, m3, m4 = (d * d).mean(-1), (d ** 3).mean(-1), (d ** 4).mean(-1)
    side = np.where(np.abs(d) < AT_MEAN, 0.0, np.sign(d))
    crossings = (np.diff(side, axis=-1) != 0).mean(-1) if x.shape[-1] > 1 else np.full(mean.shape, np.nan)
    q1, q3 = np.quantile(x, [0.25, 0.75], axis=-1)
    moving = low < high
    skew = np.where(moving, m3 / (m2 * np.sqrt(m2)), np.nan)
    kurt = np.where(moving, m4 / (m2 * m2) - 3.0, np.nan)
    return [mean, np.sqrt(m2), low, high, high - low, np.sqrt(m2 + mean * mean), high - low, crossings, np.abs(d).mean(-1), skew, kurt, q3 - q1]


def _correlations(x: np.ndarray) -> list[np.ndarray]:
    d = x - x.mean(-1, keepdims=True)
    m2, moving = (d * d).mean(-1), x.min(-1) < x.max(-1)
    places = [(SENSORS.index(a), SENSORS.index(b)) for a, b in AXIS_PAIRS]
    return [np.where(moving[:, i] & moving[:, j], (d[:, i] * d[:, j]).mean(-1) / np.sqrt(m2[:, i] * m2[:, j]), np.nan) for i, j in places]


def _motion(x: np.ndarray) -> list[np.ndarray]:
    size = [np.sqrt((x[:, i:i + 3] ** 2).sum(1)) for i in (0, 3)]
    out = [f(s) for s in size for f in (lambda s: s.mean(-1), lambda s: s.std(-1), lambda s: s.max(-1))]
    for s in size:
        step = np.abs(np.diff(s, axis=-1))
        out += [step.mean(-1), step.max(-1)] if step.shape[-1] else [np.full(len(s), np.nan)] * 2
    whole = np.sqrt(size[0] ** 2 + size[1] ** 2)
    return [*out, whole.mean(-1), whole.max(-1)]


def window_features(x: np.ndarray) -> np.ndarray:
    """(windows, 6, samples) to (windows, 134) in the order of :func:`feature_names`; NaN stands for no value.

    Sums run over adjacent samples whatever the layout of ``x``, so live and stored windows agree to the last bit."""
    x = np.ascontiguousarray(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        per_channel = np.stack(_statistics(x), axis=-1).reshape(len(x), -1)
        sma = [np.abs(x[:, i:i + 3]).sum(1).mean(-1) for i in (0, 3)]
        return np.concatenate([per_channel, np.stack([*sma, *_correlations(x)], axis=1), spectrum(x).reshape(len(x), -1),
                               np.stack(_motion(x), axis=1)], axis=1)


def _feature_columns(n_meta: int):
    """mapInArrow: the first ``n_meta`` columns as they are, then the features of the six channel arrays behind them,
    ``BLOCK`` windows at a time whatever the size of the batches."""
    names = feature_names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            channels = [batch.column(n_meta + i) for i in range(len(SENSORS))]
            size = channels[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            start, out = np.cumsum(size) - size, np.full((len(batch), len(names)), np.nan)
            flat = np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in channels]).astype(float)
            for n in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == n)
                out[rows] = window_features(flat[:, start[rows][:, None] + np.arange(n)].transpose(1, 0, 2))
            made = [pa.array(column, mask=np.isnan(column)) for column in np.ascontiguousarray(out.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_meta], *made], [*batch.schema.names[:n_meta], *names])

    return run


def spectral_features(windows: DataFrame) -> DataFrame:
    """``windows`` plus ``_spectrum``: 7 spectral features for each of the 6 channels."""
    return windows.withColumn("_spectrum", spectrum_udf(*[F.col(f"samples.{c}") for c in SENSORS]))


def spectral_columns() -> list[Column]:
    return [F.element_at("_spectrum", i + 1).alias(f"{c}_{s}")
            for i, (c, s) in enumerate((c, s) for c in SENSORS for s in SPECTRAL)]


def named_features(df: DataFrame, values: str) -> DataFrame:
    """``df`` with the array column ``values`` of :func:`window_features` as 134 named columns; NaN becomes NULL."""
    kept = [c for c in df.columns if c != values]
    value = [F.get(values, F.lit(i)) for i in range(len(feature_names()))]
    return df.select(*kept, *[F.when(~F.isnan(v), v).alias(n) for v, n in zip(value, feature_names(), strict=True)])


def extract_features(windows: DataFrame) -> DataFrame:
    """The 134 features of every window beside its other columns (``samples`` excepted).

    A constant channel has no skewness, kurtosis or correlation: those are NULL, as all are of a window without samples.
    """
    meta = windows.drop("samples").schema.fields
    rows = windows.select(*[F.col(f"`{f.name}`") for f in meta], *[F.col(f"samples.{c}").alias(f"_{c}") for c in SENSORS])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in meta] + [f"{n} double" for n in feature_names()]
    return rows.mapInArrow(_feature_columns(len(meta)), ", ".join(kinds))


def device_metrics() -> list[Column]:
    """Aggregates of a trailing window used by the live path (F21, F22, F24 to F26)."""
    acc, gyr = C.acc_magnitude(), C.gyr_magnitude()
    even = F.col("at") % 2 == 0
    l1 = F.abs("gx") + F.abs("gy") + F.abs("gz")
    # of plain values: a struct in the buffer would sort the rows of all ticks instead of hashing them
    last = F.struct(*[F.max_by(c, F.col("at")).alias(c) for c in ("ay", "az")])
    return [
        F.max(acc).alias("acc_peak"), F.min(acc).alias("acc_min"), F.max(gyr).alias("gyr_peak"),
        F.stddev_pop(acc).alias("acc_std"),
        F.avg("ax").alias("mean_ax"), F.avg("ay").alias("mean_ay"), F.avg("az").alias("mean_az"),
        F.var_pop(F.when(even, acc)).alias("even_acc_var"), F.max(F.when(even, l1)).alias("even_gyr_l1"),
        F.max(F.when(even, acc)).alias("even_acc_max"), F.min(F.when(even, acc)).alias("even_acc_min"),
        last.alias("last_sample"),
    ]


def with_device_flags(ticks: DataFrame) -> DataFrame:
    """Orientation vector, stationary and gentle flags and resting posture from the metrics."""
    return ticks.withColumns({
        "orientation": C.unit_vector(F.col("mean_ax"), F.col("mean_ay"), F.col("mean_az")),
        "stationary": (F.col("even_acc_var") < 0.05) & (F.col("even_gyr_l1") < 0.25),
        "gentle": (F.col("even_acc_max") < 15.0) & (F.col("even_acc_min") > 6.5),
        "posture": C.resting_posture(F.col("last_sample.ay"), F.col("last_sample.az")),
    }).drop("last_sample")
