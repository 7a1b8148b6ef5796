"""Queries over the sample windows, the 134 features and the on-device window metrics.

Recordings of the sensor view hold at most 500 rows, so they are ordered without slices.
"""

from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators import features as FE
from gaitframe.operators import windows as W
from gaitframe.operators.ordered import ordered_position
from gaitframe.operators.stepping import adaptive_ticks
from gaitframe.plans.catalog import query
from gaitframe.plans.sensor import clean_samples, segments, sensor_view, windows
from gaitframe.plans.sql import SENSORS, r6, with_ctes

KEYS = ["recording_id", "segment", "k"]
KEYSQL = "recording_id, segment, k"


def rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("w1_sample_windows", with_ctes(
    "SELECT recording_id, segment, k, count(*) AS n_rows, min(timestamp) AS start_ts, max(timestamp) AS end_ts"
    " FROM wr GROUP BY 1, 2, 3 HAVING count(*) = 100"))
def sample_windows(spark, sf_dir):
    return W.sample_windows(segments(spark, sf_dir))


@query("w2_label_windows", with_ctes(
    "SELECT recording_id, segment, k, subject_id, dataset_id, label, start_ts, has_fall, round(purity, 6) AS purity FROM win"))
def label_windows(spark, sf_dir):
    return W.label_windows(segments(spark, sf_dir)).withColumn("purity", F.round("purity", 6))


@query("w3_latest_n", with_ctes(
    "SELECT subject_id, n - r AS place, timestamp, ax FROM (SELECT subject_id, timestamp, ax, 100 AS n,"
    " row_number() OVER (PARTITION BY subject_id ORDER BY timestamp DESC) AS r,"
    " count(*) OVER (PARTITION BY subject_id) AS have FROM sensor) WHERE r <= 100 AND have >= 100"))
def latest(spark, sf_dir):
    rows = sensor_view(spark, sf_dir).select("subject_id", "timestamp", "ax")
    return W.latest_n(rows, 100, ["subject_id"]).select("subject_id", F.col("at").cast("long").alias("place"), "timestamp", "ax")


PEAK = (
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp) - 1 AS r FROM clean"),
    ("peaks", "SELECT recording_id, first(r ORDER BY ax*ax + ay*ay + az*az DESC, r) AS peak FROM ranked GROUP BY 1"),
    ("pw", "SELECT recording_id, timestamp, r // 50 AS k FROM ranked UNION ALL"
           " SELECT recording_id, timestamp, r // 50 - 1 FROM ranked WHERE r >= 50"),
    ("pwin", "SELECT recording_id, k, min(timestamp) AS start_ts FROM pw GROUP BY 1, 2 HAVING count(*) = 100"),
)


@query("w4_peak_windows", with_ctes(
    "SELECT recording_id, k, start_ts, peak AS peak_pos, CASE WHEN abs(k * 50 + 50 - peak) <= 50 THEN 'falling' ELSE 'lying' END AS label"
    " FROM pwin JOIN peaks USING (recording_id) WHERE abs(k * 50 + 50 - peak) <= 50 OR k * 50 + 50 > peak + 100", *PEAK))
def peak_windows(spark, sf_dir):
    return W.peak_windows(clean_samples(spark, sf_dir), slice_ms=None)


@query("j9_peak_position", with_ctes("SELECT recording_id, peak AS peak_pos FROM peaks", *PEAK))
def peak_position(spark, sf_dir):
    rows = ordered_position(clean_samples(spark, sf_dir), ["recording_id"], ["timestamp"], None)
    strongest = F.struct((-C.acc_magnitude()).alias("s"), F.col("pos").alias("p"))
    return rows.groupBy("recording_id").agg(F.min_by("pos", strongest).alias("peak_pos"))


TICKS = (
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp) - 1 AS r FROM clean"),
    ("tickrows", "SELECT t.*, r - 20 * tick AS spot FROM (SELECT *, unnest(range(greatest(0, (r - 99 + 19) // 20), r // 20 + 1)) AS tick FROM ranked) t"),
    ("ticks", "SELECT recording_id, tick, max(timestamp) AS tick_ts, sqrt(max(ax*ax+ay*ay+az*az)) AS acc_peak,"
              " sqrt(min(ax*ax+ay*ay+az*az)) AS acc_min, sqrt(max(gx*gx+gy*gy+gz*gz)) AS gyr_peak,"
              " stddev_pop(sqrt(ax*ax+ay*ay+az*az)) AS acc_std, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz,"
              " var_pop(sqrt(ax*ax+ay*ay+az*az)) FILTER (spot % 2 = 0) AS even_var,"
              " max(abs(gx)+abs(gy)+abs(gz)) FILTER (spot % 2 = 0) AS even_l1,"
              " sqrt(max(ax*ax+ay*ay+az*az) FILTER (spot % 2 = 0)) AS even_max,"
              " sqrt(min(ax*ax+ay*ay+az*az) FILTER (spot % 2 = 0)) AS even_min,"
              " max(CASE WHEN spot = 99 THEN ay END) AS last_ay, max(CASE WHEN spot = 99 THEN az END) AS last_az"
              " FROM tickrows GROUP BY 1, 2 HAVING count(*) = 100"),
)


def device_ticks(spark, sf_dir):
    return FE.with_device_flags(W.inference_ticks(clean_samples(spark, sf_dir), 400, extra=FE.device_metrics(), slice_ms=None))


@query("w5_inference_ticks", with_ctes("SELECT recording_id, tick, tick_ts FROM ticks", *TICKS))
def ticks(spark, sf_dir):
    return W.inference_ticks(clean_samples(spark, sf_dir), 400, slice_ms=None)


def damped(spark, sf_dir):
    """The sensor view with little motion while resting: gravity and a thousandth of the rest."""
    rest = F.col("label").isin("standing", "sitting", "lying", "falling")
    calm = {c: F.when(rest, F.col(c) / 1000 + (9.8 if c == "az" else 0.0)).otherwise(F.col(c)) for c in SENSORS}
    return clean_samples(spark, sf_dir).withColumns({**calm, "low": F.floor(F.col("timestamp") / 4000) % 3 == 0})


@query("w5_adaptive_ticks", with_ctes(
    "SELECT subject_id, r AS pos, timestamp AS tick_ts, still AS stationary, run::INT AS still_run, 200 * CASE WHEN run > 2 THEN 5 ELSE step END AS interval_ms FROM walk",
    ("calm", "SELECT subject_id, timestamp, CASE WHEN floor(timestamp / 4000)::BIGINT % 3 = 0 THEN 4 ELSE 2 END AS step,"
             " CASE WHEN w THEN ax / 1000 ELSE ax END AS x, CASE WHEN w THEN ay / 1000 ELSE ay END AS y, CASE WHEN w THEN az / 1000 + 9.8 ELSE az END AS z,"
             " (abs(gx) + abs(gy) + abs(gz)) / CASE WHEN w THEN 1000 ELSE 1 END AS g FROM (SELECT *, label IN ('standing', 'sitting', 'lying', 'falling') AS w FROM clean)"),
    ("placed", "SELECT *, sqrt(x*x + y*y + z*z) AS acc, row_number() OVER (PARTITION BY subject_id ORDER BY timestamp) - 1 AS r FROM calm"),
    ("trail", "SELECT subject_id, timestamp, step, r, var_pop(CASE WHEN r % 2 = 0 THEN acc END) OVER w < 0.05 AND max(CASE WHEN r % 2 = 0 THEN g END) OVER w < 0.25 AS still"
              " FROM placed WINDOW w AS (PARTITION BY subject_id ORDER BY r ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"),
    ("walk", "SELECT *, CASE WHEN still THEN 1 ELSE 0 END AS run FROM trail WHERE r = 99"
             " UNION ALL SELECT n.*, CASE WHEN n.still THEN least(p.run + 1, 3) ELSE 0 END FROM walk p JOIN trail n ON n.subject_id = p.subject_id"
             " AND n.r = p.r + 10 * CASE WHEN p.run > 2 THEN 5 ELSE p.step END")).replace("WITH ", "WITH RECURSIVE ", 1))
def adaptive(spark, sf_dir):
    """Ticks of 400 ms, 800 ms on low power and 1000 ms after still ticks, several slices per subject."""
    return adaptive_ticks(damped(spark, sf_dir), low_power=F.col("low"), keys=["subject_id"], slice_ticks=16)


@query("w6_window_summary", with_ctes(
    "SELECT label, count(*) AS n_windows, count(DISTINCT subject_id) AS n_subjects FROM win GROUP BY 1"))
def summary(spark, sf_dir):
    return W.window_summary(W.label_windows(segments(spark, sf_dir)))


@query("w7_cap_recordings", with_ctes(
    "SELECT subject_id, recording_id, count(*) AS n_rows FROM sensor JOIN kept USING (recording_id) GROUP BY 1, 2",
    ("files", "SELECT subject_id AS s, recording_id, bool_or(label = 'falling') AS f FROM sensor GROUP BY 1, 2"),
    ("kept", "SELECT recording_id FROM (SELECT recording_id, row_number() OVER (PARTITION BY s, f ORDER BY recording_id) AS r FROM files) WHERE r <= 1")))
def cap(spark, sf_dir):
    return (W.cap_recordings(sensor_view(spark, sf_dir), 1).groupBy("subject_id", "recording_id")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def feature_query(name, columns, sql_columns, extra=()):
    """Register a feature group: the named columns of every window against grouped SQL."""
    body = f"SELECT {KEYSQL}, " + ", ".join(r6(e, c) for c, e in zip(columns, sql_columns)) + " FROM wrow GROUP BY 1, 2, 3"

    @query(name, with_ctes(body, *extra))
    def run(spark, sf_dir):
        return FE.extract_features(windows(spark, sf_dir)).select(*KEYS, *rounded(*columns))


feature_query("f1_mean", [f"{c}_mean" for c in SENSORS], [f"avg({c})" for c in SENSORS])
feature_query("f2_std", [f"{c}_std" for c in SENSORS], [f"stddev_pop({c})" for c in SENSORS])
feature_query("f3_min_max", [f"{c}_{s}" for c in SENSORS for s in ("min", "max")],
              [f"{s}({c})" for c in SENSORS for s in ("min", "max")])
feature_query("f4_range", [f"{c}_{s}" for c in SENSORS for s in ("range", "peak2peak")],
              [f"max({c}) - min({c})" for c in SENSORS for _ in range(2)])
feature_query("f5_rms", [f"{c}_rms" for c in SENSORS], [f"sqrt(avg({c} * {c}))" for c in SENSORS])
feature_query("f10_iqr", [f"{c}_iqr" for c in SENSORS],
              [f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)" for c in SENSORS])
feature_query("f11_sma", ["acc_sma", "gyr_sma"],
              ["avg(abs(ax) + abs(ay) + abs(az))", "avg(abs(gx) + abs(gy) + abs(gz))"])
feature_query("f12_corr", [f"corr_{a}_{b}" for a, b in FE.AXIS_PAIRS],
              [f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END" for a, b in FE.AXIS_PAIRS])
SVM, GSVM = "sqrt(ax*ax + ay*ay + az*az)", "sqrt(gx*gx + gy*gy + gz*gz)"
feature_query("f17_svm", FE.MOTION[:6],
              [f"{f}({v})" for v in (SVM, GSVM) for f in ("avg", "stddev_pop", "max")])
feature_query("f19_resultant", FE.MOTION[10:],
              [f"{f}(sqrt(ax*ax + ay*ay + az*az + gx*gx + gy*gy + gz*gz))" for f in ("avg", "max")])

CENTRED = (
    ("means", "SELECT *, " + ", ".join(f"{c} - avg({c}) OVER w AS d{c}" for c in SENSORS) +
     f", min(gx) OVER w AS lo_gx, max(gx) OVER w AS hi_gx FROM wrow WINDOW w AS (PARTITION BY {KEYSQL})"),
    ("sides", "SELECT *, " + ", ".join(f"CASE WHEN abs(d{c}) < 1e-9 THEN 0 ELSE sign(d{c}) END AS side_{c}" for c in SENSORS) + " FROM means"),
    ("signs", "SELECT *, " + ", ".join(f"CASE WHEN spot > 0 THEN CASE WHEN side_{c} <> lag(side_{c}) OVER w THEN 1.0 ELSE 0.0 END END AS z{c}" for c in SENSORS) +
     f" FROM sides WINDOW w AS (PARTITION BY {KEYSQL} ORDER BY spot)"),
)


def centred_query(name, stat, expression):
    columns = [f"{c}_{stat}" for c in SENSORS]
    body = f"SELECT {KEYSQL}, " + ", ".join(r6(expression.format(c=c), f"{c}_{stat}") for c in SENSORS) + " FROM signs GROUP BY 1, 2, 3"

    @query(name, with_ctes(body, *CENTRED))
    def run(spark, sf_dir):
        return FE.extract_features(windows(spark, sf_dir)).select(*KEYS, *rounded(*columns))


centred_query("f6_zcr", "zcr", "avg(z{c})")
centred_query("f7_mad", "mad", "avg(abs(d{c}))")
centred_query("f8_skew", "skew", "CASE WHEN min({c}) < max({c}) THEN avg(d{c}**3) / avg(d{c}**2) ** 1.5 END")
centred_query("f9_kurt", "kurt", "CASE WHEN min({c}) < max({c}) THEN avg(d{c}**4) / avg(d{c}**2) ** 2 - 3 END")


@query("f18_jerk", with_ctes(
    f"SELECT {KEYSQL}, " + ", ".join([r6("avg(ja)", "acc_jerk_mean"), r6("max(ja)", "acc_jerk_peak"),
                                      r6("avg(jg)", "gyr_jerk_mean"), r6("max(jg)", "gyr_jerk_peak")]) +
    " FROM jerks GROUP BY 1, 2, 3",
    ("jerks", f"SELECT {KEYSQL}, abs({SVM} - lag({SVM}) OVER w) AS ja, abs({GSVM} - lag({GSVM}) OVER w) AS jg"
              f" FROM wrow WINDOW w AS (PARTITION BY {KEYSQL} ORDER BY spot)")))
def jerk(spark, sf_dir):
    return FE.extract_features(windows(spark, sf_dir)).select(*KEYS, *rounded(*FE.MOTION[6:10]))


POWER = (
    *CENTRED,
    ("axes", " UNION ALL ".join(f"SELECT {KEYSQL}, '{c}' AS axis, spot, d{c} AS d FROM means" for c in SENSORS)),
    ("waves", "SELECT j, n, cos(2 * pi() * j * n / 100) AS c, sin(2 * pi() * j * n / 100) AS s"
              " FROM range(51) a(j), range(100) b(n)"),
    ("power", f"SELECT {KEYSQL}, axis, j, sum(d * c) ** 2 + sum(d * s) ** 2 AS p FROM axes JOIN waves ON spot = n GROUP BY ALL"),
    ("share", f"SELECT *, j * 0.5 AS f, p / (sum(p) OVER (PARTITION BY {KEYSQL}, axis) + 1e-12) AS q FROM power"),
)


def spectral_query(name, stats, sql):
    columns = [f"{c}_{s}" for c in SENSORS for s in stats]
    per_axis = f"SELECT {KEYSQL}, axis, " + ", ".join(r6(e, s) for s, e in zip(stats, sql)) + " FROM share GROUP BY ALL"
    body = f"SELECT {KEYSQL}, " + ", ".join(
        f"max({s}) FILTER (axis = '{c}') AS {c}_{s}" for c in SENSORS for s in stats) + " FROM per_axis GROUP BY 1, 2, 3"

    @query(name, with_ctes(body, *POWER, ("per_axis", per_axis)))
    def run(spark, sf_dir):
        return (FE.spectral_features(windows(spark, sf_dir)).select(*KEYS, *FE.spectral_columns())
                .select(*KEYS, *rounded(*columns)))


spectral_query("f13_dominant", ["dom_freq", "dom_energy"],
               ["first(f ORDER BY p DESC, j) FILTER (j > 0)", "first(q ORDER BY p DESC, j) FILTER (j > 0)"])
spectral_query("f14_spec_entropy", ["spec_entropy"], ["-sum(q * ln(q + 1e-12)) / ln(51)"])
spectral_query("f15_spec_centroid", ["spec_centroid"], ["sum(f * q)"])
spectral_query("f16_bands", ["band_low", "band_mid", "band_high"],
               ["coalesce(sum(q) FILTER (f < 2), 0)", "coalesce(sum(q) FILTER (f >= 2 AND f < 5), 0)",
                "coalesce(sum(q) FILTER (f >= 5 AND f < 25), 0)"])


@query("v1_spectrum_udf", with_ctes(
    "SELECT label, count(*) AS n_windows, round(avg(n), 6) AS n_values FROM (SELECT label, 42 AS n FROM win) GROUP BY 1"))
def spectrum_udf(spark, sf_dir):
    rows = FE.spectral_features(windows(spark, sf_dir))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_windows"),
                                     F.round(F.avg(F.size("_spectrum")), 6).alias("n_values"))


@query("f_all_134_features")
def all_features(spark, sf_dir):
    return FE.extract_features(windows(spark, sf_dir))


@query("f21_device_metrics", with_ctes(
    "SELECT recording_id, tick, " + ", ".join(r6(c, c) for c in ("acc_peak", "acc_min", "gyr_peak", "acc_std")) + " FROM ticks", *TICKS))
def metrics(spark, sf_dir):
    return device_ticks(spark, sf_dir).select("recording_id", "tick", *rounded("acc_peak", "acc_min", "gyr_peak", "acc_std"))


NORM = "sqrt(mx*mx + my*my + mz*mz)"


@query("f22_orientation", with_ctes(
    "SELECT recording_id, tick, " + ", ".join(
        r6(f"CASE WHEN {NORM} > 0.001 THEN m{c} / {NORM} ELSE {1.0 if c == 'y' else 0.0} END", f"o{c}") for c in "xyz") + " FROM ticks", *TICKS))
def orientation(spark, sf_dir):
    return device_ticks(spark, sf_dir).select(
        "recording_id", "tick", *[F.round(f"orientation.{c}", 6).alias(f"o{c}") for c in "xyz"])


@query("f23_tilt", with_ctes(
    "SELECT recording_id, tick, " + r6(f"degrees(acos(greatest(least(my / {NORM}, 1.0), -1.0)))", "tilt") + " FROM ticks", *TICKS))
def tilt(spark, sf_dir):
    up = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    return device_ticks(spark, sf_dir).select(
        "recording_id", "tick", F.round(C.tilt_degrees(up, F.col("orientation")), 6).alias("tilt"))


@query("f24_stationary", with_ctes(
    "SELECT recording_id, tick, even_var < 0.05 AND even_l1 < 0.25 AS stationary, " + r6("even_var", "even_acc_var") + ", "
    + r6("even_l1", "even_gyr_l1") + " FROM ticks", *TICKS))
def stationary(spark, sf_dir):
    return device_ticks(spark, sf_dir).select("recording_id", "tick", "stationary", *rounded("even_acc_var", "even_gyr_l1"))


@query("f25_gentle", with_ctes(
    "SELECT recording_id, tick, even_max < 15.0 AND even_min > 6.5 AS gentle, " + r6("even_max", "even_acc_max") + ", "
    + r6("even_min", "even_acc_min") + " FROM ticks", *TICKS))
def gentle(spark, sf_dir):
    return device_ticks(spark, sf_dir).select("recording_id", "tick", "gentle", *rounded("even_acc_max", "even_acc_min"))


@query("f26_posture", with_ctes(
    "SELECT recording_id, tick, CASE WHEN abs(last_az) > 7 THEN 'lying' WHEN abs(last_ay) > 6 THEN 'standing' ELSE 'sitting' END AS posture FROM ticks", *TICKS))
def posture(spark, sf_dir):
    return device_ticks(spark, sf_dir).select("recording_id", "tick", "posture")


LOGITS = ["acc_peak", "acc_min", "gyr_peak", "acc_std"]
TOP = "greatest(acc_peak, acc_min, gyr_peak, acc_std)"


@query("f27_softmax", with_ctes(
    "SELECT recording_id, tick, " + ", ".join(
        r6(f"exp({c} - {TOP}) / (" + " + ".join(f"exp({o} - {TOP})" for o in LOGITS) + ")", f"p_{c}") for c in LOGITS) + " FROM ticks", *TICKS))
def softmax(spark, sf_dir):
    p = device_ticks(spark, sf_dir).select("recording_id", "tick", C.softmax(F.array(*LOGITS)).alias("p"))
    return p.select("recording_id", "tick", *[F.round(F.element_at("p", i + 1), 6).alias(f"p_{c}") for i, c in enumerate(LOGITS)])
