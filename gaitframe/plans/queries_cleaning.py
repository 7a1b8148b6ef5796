"""Queries over the cleaning, mapping, sorting, set and scalar operators."""

from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators import cleaning as K
from gaitframe.operators import registry as R
from gaitframe.plans.catalog import query
from gaitframe.plans.sensor import clean_samples, segments, sensor_view, table
from gaitframe.plans.sql import r6, with_ctes


def rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


def mapping_values(scheme):
    changes = R.SISFALL_SCHEMES[scheme]
    rows = [(ds, code, changes.get(code, label) if ds == "sisfall" else label)
            for ds, code, _, label in R.SOURCE_LABELS]
    return "VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)


ALIAS_VALUES = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in R.LABEL_ALIASES.items())

# Source codes spread over the rows of the view: every code of a dataset, an alias, an unknown.
CODES_SQL = """SELECT dataset_id, recording_id, timestamp, CASE
    WHEN timestamp // 20 % 7 = 0 THEN '  Jog ' WHEN timestamp // 20 % 7 = 1 THEN 'stair_up'
    WHEN timestamp // 20 % 7 = 2 THEN 'no such code'
    WHEN dataset_id = 'unimib_shar' THEN list_extract(['FKL','WAL','JOG','SCH','StdUP'], CAST(timestamp // 20 % 5 + 1 AS INTEGER))
    WHEN dataset_id = 'mobiact' THEN list_extract(['STD','WAL','JOG','SCH','FOL'], CAST(timestamp // 20 % 5 + 1 AS INTEGER))
    WHEN dataset_id = 'sisfall' THEN list_extract(['D06','D10','F05','D16','D19'], CAST(timestamp // 20 % 5 + 1 AS INTEGER))
    ELSE list_extract(['ADL03','ADL08','FALL01','ADL05','fall'], CAST(timestamp // 20 % 5 + 1 AS INTEGER)) END AS original_label
  FROM sensor"""


def coded_rows(spark, sf_dir):
    tick = F.floor(F.col("timestamp") / 20)
    pick = (tick % 5 + 1).cast("int")

    def one_of(*codes):
        return F.element_at(F.array(*[F.lit(c) for c in codes]), pick)

    ds = F.col("dataset_id")
    code = (F.when(tick % 7 == 0, "  Jog ").when(tick % 7 == 1, "stair_up").when(tick % 7 == 2, "no such code")
            .when(ds == "unimib_shar", one_of("FKL", "WAL", "JOG", "SCH", "StdUP"))
            .when(ds == "mobiact", one_of("STD", "WAL", "JOG", "SCH", "FOL"))
            .when(ds == "sisfall", one_of("D06", "D10", "F05", "D16", "D19"))
            .otherwise(one_of("ADL03", "ADL08", "FALL01", "ADL05", "fall")))
    return sensor_view(spark, sf_dir).withColumn("original_label", code)


def mapped_sql(scheme):
    return with_ctes(
        "SELECT c.dataset_id, c.original_label, coalesce(m.unified, a.unified, 'unknown') AS unified_label, count(*) AS n_rows\n"
        "FROM coded c LEFT JOIN codes m ON m.ds = c.dataset_id AND m.code = c.original_label\n"
        "LEFT JOIN names a ON a.alias = lower(trim(c.original_label)) GROUP BY 1, 2, 3",
        ("coded", CODES_SQL), ("codes", f"SELECT * FROM ({mapping_values(scheme)}) t(ds, code, unified)"),
        ("names", f"SELECT * FROM ({ALIAS_VALUES}) t(alias, unified)"))


def mapped_counts(spark, sf_dir, scheme):
    return (R.map_labels(coded_rows(spark, sf_dir), scheme)
            .groupBy("dataset_id", "original_label", "unified_label").agg(F.count(F.lit(1)).alias("n_rows")))


@query("p1_coerce_numeric", with_ctes(
    "SELECT recording_id, count(*) AS n_rows, count(ax) AS n_ax, " + r6("sum(ax)", "sum_ax") +
    " FROM (SELECT recording_id, CASE WHEN timestamp % 60 = 0 THEN NULL ELSE ax END AS ax FROM sensor) GROUP BY 1"))
def coerce(spark, sf_dir):
    text = F.when(F.col("timestamp") % 60 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("ax").cast("string")))
    rows = K.coerce_numeric(sensor_view(spark, sf_dir).withColumn("ax", text), ["ax"])
    return rows.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("ax").alias("n_ax"), F.round(F.sum("ax"), 6).alias("sum_ax"))


@query("p2_clean_labels", with_ctes(
    "SELECT label, count(*) AS n_rows FROM sensor WHERE timestamp % 140 <> 0 GROUP BY 1"))
def clean_labels(spark, sf_dir):
    odd = F.when(F.col("timestamp") % 140 == 0, "jumping").otherwise(
        F.concat(F.lit("  "), F.initcap("label"), F.lit(" ")))
    return (K.clean_labels(sensor_view(spark, sf_dir).withColumn("label", odd))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")))


@query("p3_drop_out_of_range", with_ctes(
    "SELECT dataset_id, count(*) AS n_rows, max(ax) AS max_ax FROM sensor WHERE abs(ax) <= 40 AND abs(ay) <= 40"
    " AND abs(az) <= 40 AND coalesce(abs(gx) <= 35 AND abs(gy) <= 35 AND abs(gz) <= 35, true) GROUP BY 1"))
def bounds(spark, sf_dir):
    return K.drop_out_of_range(sensor_view(spark, sf_dir)).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("ax").alias("max_ax"))


@query("p4_drop_missing", with_ctes(
    "SELECT dataset_id, count(*) AS n_rows FROM sensor WHERE gx IS NOT NULL AND gy IS NOT NULL AND gz IS NOT NULL"
    " AND ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL GROUP BY 1"))
def dropna(spark, sf_dir):
    return K.drop_missing(sensor_view(spark, sf_dir)).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("p5_unit_conversion", with_ctes(
    "SELECT recording_id, timestamp, " + ", ".join([
        r6("ax * (32.0 / 8192.0) * CAST(9.80665 AS DOUBLE)", "ax_adc"),
        r6("ay * CAST(9.80665 AS DOUBLE)", "ay_g"),
        r6("gx * (4000.0 / 65536.0) * pi() / 180.0", "gx_adc"), r6("gy * pi() / 180.0", "gy_deg")]) + " FROM sensor"))
def units(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    rows = rows.select(
        "*", *[F.struct(*[F.col(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")]).alias("raw")])
    adc = K.to_si(rows, "adc", "adc").select(
        "recording_id", "timestamp", "raw", F.col("ax").alias("ax_adc"), F.col("gx").alias("gx_adc"))
    other = K.to_si(adc.select("*", "raw.*"), "g", "deg/s")
    return other.select("recording_id", "timestamp", F.round("ax_adc", 6).alias("ax_adc"),
                        F.round("ay", 6).alias("ay_g"), F.round("gx_adc", 6).alias("gx_adc"),
                        F.round("gy", 6).alias("gy_deg"))


@query("p6_decimate", with_ctes(
    "SELECT recording_id, timestamp, ax FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp) - 1 AS r"
    " FROM sensor) WHERE r % 4 = 0"))
def decimate(spark, sf_dir):
    return K.decimate(sensor_view(spark, sf_dir), 4).select("recording_id", "timestamp", "ax")


@query("p7_synth_timestamps", with_ctes(
    "SELECT recording_id, ax, 1600000000000 + 5 * (row_number() OVER (PARTITION BY recording_id ORDER BY timestamp) - 1) AS timestamp FROM sensor"))
def synth(spark, sf_dir):
    rows = sensor_view(spark, sf_dir).withColumnRenamed("timestamp", "line_no")
    return K.synth_timestamps(rows, 200).select("recording_id", "ax", "timestamp")


@query("p8_map_labels", mapped_sql("nine"))
def map_nine(spark, sf_dir):
    return mapped_counts(spark, sf_dir, "nine")


@query("p9_map_labels_six", mapped_sql("six"))
def map_six(spark, sf_dir):
    return mapped_counts(spark, sf_dir, "six")


@query("p9_map_labels_six_stairs_walking", mapped_sql("six_stairs_walking"))
def map_six_stairs(spark, sf_dir):
    return mapped_counts(spark, sf_dir, "six_stairs_walking")


@query("p10_conform", with_ctes(
    "SELECT dataset_id, subject_id, recording_id, timestamp, ax, ay, az, gx, gy, gz, CAST(NULL AS VARCHAR) AS original_label,"
    " label AS unified_label, phone_position, CAST(NULL AS INTEGER) AS segment FROM sensor"))
def conform(spark, sf_dir):
    return K.conform(sensor_view(spark, sf_dir).withColumnRenamed("label", "unified_label"))


@query("p11_gyro_flag", with_ctes(
    "SELECT dataset_id, gx IS NOT NULL AS has_gyro, count(*) AS n_rows, " + r6("sum(abs(coalesce(gx, 0.0)))", "sum_gx") +
    " FROM sensor GROUP BY 1, 2"))
def gyro_flag(spark, sf_dir):
    return K.add_gyro_flag(sensor_view(spark, sf_dir)).groupBy("dataset_id", "has_gyro").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.abs("gx")), 6).alias("sum_gx"))


@query("p12_age_group", with_ctes(
    "SELECT CASE WHEN subject_id LIKE '%older%' THEN 'older_adult' WHEN subject_id LIKE '%young%' THEN 'young_adult'"
    " WHEN subject_id LIKE 'own%' THEN 'unknown' ELSE 'adult' END AS age_group, count(*) AS n_rows,"
    " count(DISTINCT subject_id) AS n_subjects FROM sensor GROUP BY 1"))
def age(spark, sf_dir):
    return (K.add_age_group(sensor_view(spark, sf_dir)).groupBy("age_group", "subject_id")
            .agg(F.count(F.lit(1)).alias("n")).groupBy("age_group")
            .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects")))


@query("p13_keep_trainable", with_ctes(
    "SELECT unified, count(*) AS n_rows FROM (SELECT coalesce(m.unified, a.unified, 'unknown') AS unified"
    " FROM coded c LEFT JOIN codes m ON m.ds = c.dataset_id AND m.code = c.original_label"
    " LEFT JOIN names a ON a.alias = lower(trim(c.original_label))) WHERE unified <> 'unknown' GROUP BY 1",
    ("coded", CODES_SQL), ("codes", f"SELECT * FROM ({mapping_values('nine')}) t(ds, code, unified)"),
    ("names", f"SELECT * FROM ({ALIAS_VALUES}) t(alias, unified)")).replace("SELECT unified,", "SELECT unified AS unified_label,", 1))
def trainable(spark, sf_dir):
    return (K.keep_trainable(R.map_labels(coded_rows(spark, sf_dir)))
            .groupBy("unified_label").agg(F.count(F.lit(1)).alias("n_rows")))


# Gaps of one to six rows, some longer than the limit, at fixed phases of the clock.
HOLES = "timestamp // 20 % 50 IN (3, 10, 11, 20, 21, 22, 30, 31, 32, 33, 34, 35, 36, 37)"


@query("p14_interpolate", with_ctes(
    "SELECT recording_id, timestamp, round(CASE WHEN ax IS NOT NULL THEN ax"
    " WHEN r - pr <= 3 OR nr - r <= 3 THEN CASE WHEN pr IS NULL THEN nv WHEN nr IS NULL THEN pv"
    " ELSE pv + (nv - pv) * (r - pr) / (nr - pr) END END, 6) + 0.0 AS ax FROM filled",
    ("holed", f"SELECT recording_id, timestamp, CASE WHEN {HOLES} THEN NULL ELSE ax END AS ax,"
              " row_number() OVER (PARTITION BY recording_id ORDER BY timestamp) AS r FROM sensor"),
    ("filled", "SELECT *, last_value(CASE WHEN ax IS NOT NULL THEN r END IGNORE NULLS) OVER p AS pr,"
               " last_value(ax IGNORE NULLS) OVER p AS pv,"
               " first_value(CASE WHEN ax IS NOT NULL THEN r END IGNORE NULLS) OVER n AS nr,"
               " first_value(ax IGNORE NULLS) OVER n AS nv FROM holed"
               " WINDOW p AS (PARTITION BY recording_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
               " n AS (PARTITION BY recording_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")))
def interpolate(spark, sf_dir):
    phase = F.floor(F.col("timestamp") / 20) % 50
    holed = F.when(phase.isin(3, 10, 11, 20, 21, 22, 30, 31, 32, 33, 34, 35, 36, 37), None).otherwise(F.col("ax"))
    rows = sensor_view(spark, sf_dir).withColumn("ax", holed).select("recording_id", "timestamp", "ax")
    return K.interpolate(rows, 3, cols=["ax"], slice_ms=None).withColumn("ax", F.round("ax", 6))


@query("p15_segments", with_ctes(
    "SELECT recording_id, segment, count(*) AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts,"
    " max(pos) AS last_pos FROM seg GROUP BY 1, 2"))
def add_segments(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("recording_id", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"), F.max("pos").alias("last_pos"))


@query("p16_report_defaults", with_ctes(
    "SELECT 'synthetic' AS dataset_id, subject_id, concat(subject_id, '_s0') AS recording_id, label AS unified_label,"
    " 'unknown' AS phone_position, gx IS NOT NULL AS has_gyro, count(*) AS n_rows FROM sensor GROUP BY 1, 2, 3, 4, 5, 6"))
def defaults(spark, sf_dir):
    rows = sensor_view(spark, sf_dir).select(F.col("subject_id").alias("subject"), "label", "gx")
    return K.with_report_defaults(rows).groupBy(
        "dataset_id", "subject_id", "recording_id", "unified_label", "phone_position", "has_gyro").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("p16_window_defaults", with_ctes(
    "SELECT subject_id, label, 0 AS segment, 20 * (row_number() OVER (PARTITION BY subject_id ORDER BY timestamp) - 1) AS timestamp FROM sensor"))
def window_defaults(spark, sf_dir):
    rows = sensor_view(spark, sf_dir).select(
        F.col("subject_id").alias("subject"), F.col("label").alias("unified_label"), F.col("timestamp").alias("line_no"))
    return K.with_window_defaults(rows).select("subject_id", "label", "segment", "timestamp")


@query("p17_phone_position", with_ctes(
    "SELECT CASE WHEN phone_position LIKE '%waist%' THEN 'waist_belt' WHEN phone_position LIKE '%wrist%' THEN 'wrist'"
    " ELSE phone_position END AS position, count(*) AS n_rows FROM sensor GROUP BY 1"))
def position(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("phone_position"), F.lit(" "))
    return (sensor_view(spark, sf_dir).select(C.phone_position(raw).alias("position"))
            .groupBy("position").agg(F.count(F.lit(1)).alias("n_rows")))


@query("p18_registry_lookup", with_ctes(
    "SELECT s.dataset_id, r.rate AS sampling_rate_hz, r.unit AS gyr_unit, count(*) AS n_rows FROM sensor s"
    " JOIN (VALUES ('unimib_shar', 50, 'n/a'), ('mobiact', 200, 'deg/s'), ('sisfall', 200, 'deg/s'), ('kfall', 100, 'rad/s'))"
    " r(ds, rate, unit) ON r.ds = s.dataset_id GROUP BY 1, 2, 3"))
def registry(spark, sf_dir):
    known = F.broadcast(R.registry(spark).select("dataset_id", "sampling_rate_hz", "gyr_unit"))
    return (sensor_view(spark, sf_dir).join(known, "dataset_id").groupBy("dataset_id", "sampling_rate_hz", "gyr_unit")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("p19_label_mapping", with_ctes(
    "SELECT m.ds AS dataset_id, m.code AS original_label, m.unified AS unified_label, count(c.dataset_id) AS n_rows"
    " FROM codes m LEFT JOIN coded c ON m.ds = c.dataset_id AND m.code = c.original_label GROUP BY 1, 2, 3",
    ("coded", CODES_SQL), ("codes", f"SELECT * FROM ({mapping_values('nine')}) t(ds, code, unified)")))
def mapping(spark, sf_dir):
    seen = coded_rows(spark, sf_dir).groupBy("dataset_id", "original_label").agg(F.count(F.lit(1)).alias("n_rows"))
    return (R.label_mapping(spark).drop("description").join(seen, ["dataset_id", "original_label"], "left")
            .na.fill(0, ["n_rows"]))


@query("p20_magnitudes", with_ctes(
    "SELECT recording_id, timestamp, " + ", ".join([
        r6("sqrt(ax*ax + ay*ay + az*az)", "acc_svm"), r6("sqrt(gx*gx + gy*gy + gz*gz)", "gyr_svm"),
        r6("sqrt(ax*ax + ay*ay + az*az + gx*gx + gy*gy + gz*gz)", "resultant")]) + " FROM clean"))
def magnitudes(spark, sf_dir):
    return clean_samples(spark, sf_dir).select(
        "recording_id", "timestamp", F.round(C.acc_magnitude(), 6).alias("acc_svm"),
        F.round(C.gyr_magnitude(), 6).alias("gyr_svm"), F.round(C.resultant(), 6).alias("resultant"))


@query("t1_sort_samples", with_ctes("SELECT subject_id, timestamp, ax, label FROM sensor ORDER BY subject_id, timestamp"))
def sort(spark, sf_dir):
    return K.sort_samples(sensor_view(spark, sf_dir), total_order=True).select("subject_id", "timestamp", "ax", "label")


@query("t4_first_per_subject", with_ctes(
    "SELECT subject_id, recording_id, timestamp, ax FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY timestamp) AS r"
    " FROM sensor) WHERE r = 1"))
def first_per_key(spark, sf_dir):
    # an aggregate, so map tasks keep one row per subject
    kept = F.min_by(F.struct("recording_id", "timestamp", "ax"), "timestamp").alias("s")
    return sensor_view(spark, sf_dir).groupBy("subject_id").agg(kept).select("subject_id", "s.*")


@query("u1_union_sources", with_ctes(
    "SELECT dataset_id, count(*) AS n_rows, count(gx) AS n_gx, count(phone_position) AS n_position FROM"
    " (SELECT dataset_id, gx, phone_position FROM sensor WHERE dataset_id <> 'unimib_shar'"
    " UNION ALL SELECT dataset_id, NULL, NULL FROM sensor WHERE dataset_id = 'unimib_shar') GROUP BY 1"))
def union_sources(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    with_gyro = rows.filter("dataset_id <> 'unimib_shar'")
    without = rows.filter("dataset_id = 'unimib_shar'").drop("gx", "gy", "gz", "phone_position")
    return (with_gyro.unionByName(without, allowMissingColumns=True).groupBy("dataset_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count("gx").alias("n_gx"),
                 F.count("phone_position").alias("n_position")))


def labels_of(rows, *datasets):
    return rows.filter(F.col("dataset_id").isin(*datasets)).select("label", "phone_position").distinct()


@query("u2_intersect", with_ctes(
    "SELECT label, phone_position FROM sensor WHERE dataset_id IN ('mobiact', 'sisfall') INTERSECT"
    " SELECT label, phone_position FROM sensor WHERE dataset_id IN ('kfall', 'own')"))
def intersect(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    return labels_of(rows, "mobiact", "sisfall").intersect(labels_of(rows, "kfall", "own"))


@query("u3_union_distinct", with_ctes(
    "SELECT label, phone_position FROM sensor WHERE dataset_id = 'mobiact' UNION"
    " SELECT label, phone_position FROM sensor WHERE dataset_id = 'kfall'"))
def union_distinct(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    return labels_of(rows, "mobiact").union(labels_of(rows, "kfall")).distinct()


@query("u4_except", with_ctes(
    "SELECT subject_id FROM sensor EXCEPT SELECT subject_id FROM sensor WHERE dataset_id = 'sisfall'"))
def except_(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    subjects = rows.select("subject_id", "dataset_id").distinct()
    return subjects.select("subject_id").exceptAll(subjects.filter("dataset_id = 'sisfall'").select("subject_id"))


@query("x1_strings", with_ctes(
    "SELECT recording_id, upper(dataset_id) AS dataset_upper, split_part(recording_id, '_r', 2) AS session,"
    " lpad(regexp_extract(recording_id, '([0-9]+)_r', 1), 3, '0') AS padded,"
    " concat_ws('_', trim(concat(' ', label, ' ')), lower('ADL')) AS tag, contains(subject_id, 'older') AS older, count(*) AS n_rows"
    " FROM sensor GROUP BY 1, 2, 3, 4, 5, 6"))
def strings(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    return rows.select(
        "recording_id", F.upper("dataset_id").alias("dataset_upper"),
        F.element_at(F.split("recording_id", "_r"), -1).alias("session"),
        F.lpad(F.regexp_extract("recording_id", "([0-9]+)_r", 1), 3, "0").alias("padded"),
        F.concat_ws("_", F.trim(F.concat(F.lit(" "), F.col("label"), F.lit(" "))), F.lower(F.lit("ADL"))).alias("tag"),
        F.col("subject_id").contains("older").alias("older"),
    ).groupBy("recording_id", "dataset_upper", "session", "padded", "tag", "older").agg(F.count(F.lit(1)).alias("n_rows"))


@query("x2_time", """SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y%m%d_%H%M%S') AS stamp,
  printf('%02d:%02d', (ms // 1000 % 6000) // 60, ms // 1000 % 60) AS elapsed
FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)""")
def time_formats(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", ms.alias("ms"))
    return events.select(
        "event_id", F.date_format(F.timestamp_millis("ms"), "yyyyMMdd_HHmmss").alias("stamp"),
        C.clock_mm_ss(F.floor(F.col("ms") / 1000) % 6000).alias("elapsed"))


@query("x3_math", with_ctes(
    "SELECT recording_id, timestamp, " + ", ".join([
        r6("round_even(ax * 2, 0)", "half_even"), r6("degrees(acos(greatest(least(az / 10, 1.0), -1.0)))", "angle"),
        r6("sin(ax) * cos(ay)", "waves"), r6("exp(-abs(ax)) + ln(abs(ay) + 1)", "curves"), r6("sign(ax)", "side")]) + " FROM sensor"))
def math(spark, sf_dir):
    return sensor_view(spark, sf_dir).select(
        "recording_id", "timestamp", F.round(F.bround(F.col("ax") * 2, 0), 6).alias("half_even"),
        F.round(F.degrees(F.acos(F.greatest(F.least(F.col("az") / 10, F.lit(1.0)), F.lit(-1.0)))), 6).alias("angle"),
        F.round(F.sin("ax") * F.cos("ay"), 6).alias("waves"),
        F.round(F.exp(-F.abs("ax")) + F.log(F.abs("ay") + 1), 6).alias("curves"), F.signum("ax").alias("side"))


@query("x4_arrays", with_ctes(
    "SELECT recording_id, timestamp, list_position([ax, ay, az], list_max([ax, ay, az])) AS arg_max,"
    " len(flatten([[ax, ay, az], [gx, gy, gz]])) AS n_values,"
    + r6("exp(ax - greatest(ax, ay, az)) / (exp(ax - greatest(ax, ay, az)) + exp(ay - greatest(ax, ay, az)) + exp(az - greatest(ax, ay, az)))", "p_ax")
    + " FROM clean"))
def arrays(spark, sf_dir):
    acc = F.array("ax", "ay", "az")
    return clean_samples(spark, sf_dir).select(
        "recording_id", "timestamp", F.array_position(acc, F.array_max(acc)).alias("arg_max"),
        F.size(F.flatten(F.array(acc, F.array("gx", "gy", "gz")))).cast("long").alias("n_values"),
        F.round(F.element_at(C.softmax(acc), 1), 6).alias("p_ax"))


@query("x5_maps", with_ctes(
    "SELECT label, CASE label WHEN 'falling' THEN 0 WHEN 'lying' THEN 1 WHEN 'running' THEN 2 WHEN 'sitting' THEN 3"
    " WHEN 'standing' THEN 4 WHEN 'walking' THEN 5 END AS code, count(*) AS n_rows FROM sensor GROUP BY 1, 2"))
def maps(spark, sf_dir):
    names = ["falling", "lying", "running", "sitting", "standing", "walking"]
    codes = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return (sensor_view(spark, sf_dir).withColumn("code", F.element_at(codes, F.col("label")))
            .groupBy("label", "code").agg(F.count(F.lit(1)).alias("n_rows")))


@query("x6_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, value
FROM events""")
def json(spark, sf_dir):
    doc = F.to_json(F.struct(F.col("event_type").alias("kind"), "value"))
    back = F.from_json(doc, "kind string, value double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), back["kind"].alias("kind"),
        back["value"].alias("value"))

