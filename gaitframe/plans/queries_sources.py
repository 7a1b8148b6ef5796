"""Queries over the readers and sinks. The files are written from the sensor view, one per recording, and read back."""

import warnings

from pyspark.sql import functions as F

from gaitframe.operators.reports import dataset_summary
from gaitframe.plans.catalog import query
from gaitframe.plans.queries_reports import SPLIT, report_rows
from gaitframe.plans.sensor import clean_samples, sensor_view, windows
from gaitframe.plans.sql import r6, with_ctes
from gaitframe.schema import SENSORS
from gaitframe.session import scratch_path
from gaitframe.sources import recordings as R
from gaitframe.sources import sinks as S
from gaitframe.sources.lines import UnreadableFile, quarantine, read_lines, unread_files, with_header


def text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def as_files(rows, path, header, value):
    """Root of a new folder with the rows of the view as one file per recording, header first."""
    root = scratch_path(rows.sparkSession, "recordings")
    line = [path.alias("file_path"), F.lit(0).cast("long").alias("block_start"), F.col("timestamp").alias("line_id"), value.alias("value")]
    S.write_text_files(rows.select(*line, *([] if header is None else [header.alias("header")])), root)
    return root


def session_files(spark, sf_dir):
    """Two header orders, mixed by the parity of the session; every 61st line has a field too many."""
    rows = sensor_view(spark, sf_dir)
    session = F.regexp_extract("recording_id", "(r[0-9]+)$", 1)
    even = F.regexp_extract("recording_id", "r([0-9]+)$", 1).cast("long") % 2 == 0
    path = F.concat(F.translate("subject_id", "_", "-"), F.lit("_"), session, F.lit("_"), F.translate("phone_position", "_", "-"), F.lit(".csv"))
    forward = F.concat_ws(",", *[text(c) for c in ("timestamp", *SENSORS)], F.initcap("label"))
    backward = F.concat_ws(",", F.col("label"), *[text(c) for c in (*reversed(SENSORS), "timestamp")])
    extra = F.when(F.floor(F.col("timestamp") / 20) % 61 == 0, ",surplus").otherwise("")
    value = F.concat(F.when(even, forward).otherwise(backward), extra)
    header = F.when(even, "timestamp,ax,ay,az,gx,gy,gz,label").otherwise(" Label,GZ,gy,gx,az,ay,ax, Timestamp")
    return as_files(rows, path, header, value)


STEM = "concat(translate(subject_id, '_', '-'), '_', regexp_extract(recording_id, '(r[0-9]+)$', 1), '_', translate(phone_position, '_', '-'))"
GOOD = ("good", "SELECT * FROM sensor WHERE timestamp // 20 % 61 <> 0")


@query("s1_sessions", with_ctes(
    "SELECT subject_id, recording_id, segment, count(*) AS n_rows, " + r6("sum(ax)", "sum_ax") + ", max(pos) AS last_pos FROM numbered GROUP BY 1, 2, 3", GOOD,
    ("kept", f"SELECT translate(subject_id, '_', '-') AS subject_id, {STEM} AS recording_id, timestamp, ax FROM good WHERE gx IS NOT NULL AND abs(ax) <= 40 AND abs(ay) <= 40 AND abs(az) <= 40"),
    ("jumps", "SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY recording_id ORDER BY timestamp) > 500 THEN 1 ELSE 0 END AS c FROM kept"),
    ("parts", "SELECT *, CAST(sum(c) OVER (PARTITION BY recording_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS segment FROM jumps"),
    ("numbered", "SELECT *, row_number() OVER (PARTITION BY recording_id, segment ORDER BY timestamp) - 1 AS pos FROM parts")))
def s1(spark, sf_dir):
    return R.read_sessions(spark, session_files(spark, sf_dir), bounded=True).groupBy("subject_id", "recording_id", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("ax"), 6).alias("sum_ax"), F.max("pos").alias("last_pos"))


@query("s2_own_recordings", with_ctes(
    "SELECT concat('own_', translate(subject_id, '_', '-')) AS subject_id, concat('own_', translate(subject_id, '_', '-'), '_', regexp_extract(recording_id, '(r[0-9]+)$', 1)) AS recording_id,"
    " translate(phone_position, '_', '-') AS phone_position, label AS unified_label, count(*) AS n_rows, count(gx) AS n_gx FROM good GROUP BY ALL", GOOD))
def s2(spark, sf_dir):
    return R.read_own(spark, session_files(spark, sf_dir)).groupBy("subject_id", "recording_id", "phone_position", "unified_label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("gx").alias("n_gx"))


# One folder per source code; the codes go round by session, the last one is unknown.
CODES = ["STD", "WAL", "JOG", "STU", "FOL", "XXX"]


@query("s3_per_label_folders", with_ctes(
    "SELECT recording_id, unified_label, timestamp, " + ", ".join([r6("ax", "ax"), r6("gx * pi() / 180", "gx")]) + " FROM"
    " (SELECT *, row_number() OVER (PARTITION BY file ORDER BY timestamp) - 1 AS n FROM coded) WHERE n % 4 = 0 AND code <> 'XXX'",
    ("coded", "SELECT *, concat('mobiact_', printf('%03d', CAST(regexp_extract(recording_id, '_([0-9]+)_r', 1) AS BIGINT)), '_', code, '_', dataset_id, regexp_extract(recording_id, '_r([0-9]+)$', 1)) AS file,"
              " CASE code WHEN 'STD' THEN 'standing' WHEN 'WAL' THEN 'walking' WHEN 'JOG' THEN 'running' WHEN 'STU' THEN 'stairs_up' WHEN 'FOL' THEN 'falling' END AS unified_label FROM"
              " (SELECT *, list_extract(['STD', 'WAL', 'JOG', 'STU', 'FOL', 'XXX'], CAST(l % 6 + 1 AS INTEGER)) AS code FROM (SELECT *, CAST(regexp_extract(recording_id, '_([0-9]+)_r', 1) AS BIGINT) + CAST(regexp_extract(recording_id, '_r([0-9]+)$', 1) AS BIGINT) AS l FROM sensor))")).replace("SELECT recording_id, unified_label, timestamp", "SELECT file AS recording_id, unified_label, timestamp"))
def s3(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    supp, session = F.regexp_extract("recording_id", "_([0-9]+)_r", 1), F.regexp_extract("recording_id", "_r([0-9]+)$", 1)
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), ((supp.cast("long") + session.cast("long")) % 6 + 1).cast("int"))
    trial = F.concat(F.translate("dataset_id", "_", "."), session)
    path = F.concat(F.lit("MobiAct/"), F.lower(code), F.lit("/"), code, F.lit("_"), supp, F.lit("_"), trial, F.lit(".csv"))
    odd = supp.cast("long") % 2 == 1
    header = F.when(odd, "timestamp,acc_x,acc_y,acc_z,gyro_x,gyro_y,gyro_z,azimuth").otherwise("Time,Accel_X,Accel_Y,Accel_Z,GX,GY,GZ")
    value = F.concat_ws(",", *[text(c) for c in ("timestamp", *SENSORS)])
    value = F.concat(value, F.when(F.col("timestamp") % 400 == 0, " # marked").otherwise(""))
    out = R.read_mobiact(spark, as_files(rows, path, header, value))
    return out.select(F.translate("recording_id", ".", "_").alias("recording_id"), "unified_label", "timestamp",
                      F.round("ax", 6).alias("ax"), F.round("gx", 6).alias("gx"))


def numbers(*columns):
    return F.concat_ws(",", *[F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100).cast("long").cast("string") for c in columns])


@query("s4_adc_text", with_ctes(
    "SELECT recording_id, unified_label, timestamp, " + r6("adc * (32.0 / 8192.0) * CAST(9.80665 AS DOUBLE)", "ax") + " FROM"
    " (SELECT file AS recording_id, CASE WHEN code = 'F05' THEN 'falling' WHEN code = 'D06' THEN 'stairs_up' ELSE 'transition' END AS unified_label,"
    " 1600000000000 + 5 * n AS timestamp, adc, n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY timestamp) - 1 AS n FROM coded)) WHERE n % 4 = 0",
    ("coded", "SELECT timestamp, round(ax * 100, 0) AS adc, code, concat('sisfall_', CASE WHEN l % 2 = 0 THEN 'older' ELSE 'young' END, printf('%02d', l), '_', code, '_r', printf('%02d', s)) AS file FROM"
              " (SELECT *, list_extract(['F05', 'D06', 'D10'], CAST(s % 3 + 1 AS INTEGER)) AS code FROM (SELECT *, CAST(regexp_extract(recording_id, '_([0-9]+)_r', 1) AS BIGINT) AS l,"
              " CAST(regexp_extract(recording_id, '_r([0-9]+)$', 1) AS BIGINT) AS s FROM sensor))")))
def s4(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    supp, session = F.regexp_extract("recording_id", "_([0-9]+)_r", 1).cast("long"), F.regexp_extract("recording_id", "_r([0-9]+)$", 1).cast("long")
    code = F.element_at(F.array(F.lit("F05"), F.lit("D06"), F.lit("D10")), (session % 3 + 1).cast("int"))
    folder = F.concat(F.when(supp % 2 == 0, "SA").otherwise("SE"), F.format_string("%02d", supp))
    path = F.concat(F.lit("SisFall_dataset/"), folder, F.lit("/"), code, F.lit("_"), folder, F.lit("_R"), F.format_string("%02d", session), F.lit(".txt"))
    root = as_files(rows, path, None, F.concat(numbers(*SENSORS), F.lit(";")))
    return R.read_sisfall(spark, root).select("recording_id", "unified_label", "timestamp", F.round("ax", 6).alias("ax"))


@query("s5_two_positions", with_ctes(
    "SELECT recording_id, phone_position, unified_label, timestamp, " + ", ".join([r6("ax", "ax"), r6("gx", "gx")]) + " FROM"
    " (SELECT *, file AS recording_id_out, 1600000000000 + 10 * n AS ts_out FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY timestamp) - 1 AS n FROM coded)) WHERE n % 2 = 0",
    ("coded", "SELECT timestamp, ax, gx, concat('kfall_', printf('%02d', l), '_ADL03_T', printf('%02d', s), '_', CASE WHEN l % 2 = 0 THEN 'waist' ELSE 'Wrist' END) AS file,"
              " CASE WHEN l % 2 = 0 THEN 'waist_belt' ELSE 'wrist' END AS phone_position, 'walking' AS unified_label FROM (SELECT *,"
              " CAST(regexp_extract(recording_id, '_([0-9]+)_r', 1) AS BIGINT) AS l, CAST(regexp_extract(recording_id, '_r([0-9]+)$', 1) AS BIGINT) AS s FROM sensor)")
    ).replace("SELECT recording_id, phone_position, unified_label, timestamp,", "SELECT recording_id_out AS recording_id, phone_position, unified_label, ts_out AS timestamp,"))
def s5(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    supp, session = F.regexp_extract("recording_id", "_([0-9]+)_r", 1).cast("long"), F.regexp_extract("recording_id", "_r([0-9]+)$", 1).cast("long")
    who = F.concat(F.lit("S"), F.format_string("%02d", supp))
    path = F.concat(F.lit("KFall/KFall_dataset/"), who, F.lit("/"), who, F.lit("_ADL03_T"), F.format_string("%02d", session), F.lit("_"),
                    F.when(supp % 2 == 0, "waist").otherwise("Wrist"), F.lit(".csv"))
    value = F.concat_ws(",", F.lit("7"), *[text(c) for c in SENSORS])
    root = as_files(rows, path, F.lit("SampleTimeFine,acc_x,acc_y,acc_z,gyr_x,gyr_y,gyr_z"), value)
    return R.read_kfall(spark, root).select("recording_id", "phone_position", "unified_label", "timestamp", F.round("ax", 6).alias("ax"), F.round("gx", 6).alias("gx"))


@query("s6_precut_windows", with_ctes(
    "SELECT concat('unimib_', printf('%02d', CAST(regexp_extract(w.subject_id, '([0-9]+)$', 1) AS BIGINT)), '_adl_', printf('%04d', i)) AS recording_id,"
    " 1600000000000 + i * 9060 + w.spot * 20 AS timestamp, " + r6("ax", "ax") + ", CASE i % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'running' ELSE 'unknown' END AS unified_label"
    " FROM wrow w JOIN numbered USING (recording_id, segment, k)",
    ("numbered", "SELECT recording_id, segment, k, CAST(regexp_extract(recording_id, '_([0-9]+)_r', 1) AS BIGINT) * 100 + CAST(regexp_extract(recording_id, 'r([0-9]+)$', 1) AS BIGINT) * 8 + segment * 4 + k AS i FROM win")))
def s6(spark, sf_dir):
    supp, session = F.regexp_extract("recording_id", "_([0-9]+)_r", 1).cast("long"), F.regexp_extract("recording_id", "r([0-9]+)$", 1).cast("long")
    number = supp * 100 + session * 8 + F.col("segment") * 4 + F.col("k")
    flat = F.flatten(F.transform("samples", lambda s: F.array(s["ax"], s["ay"], s["az"])))
    cut = windows(spark, sf_dir).select(F.lit("adl").alias("kind"), number.alias("w"), flat.alias("values"),
                                        (number % 3 + 1).cast("int").alias("class_index"), F.regexp_extract("subject_id", "([0-9]+)$", 1).cast("int").alias("subject"))
    names = spark.createDataFrame([("adl", 1, "WAL"), ("adl", 2, "JOG")], "kind string, class_index int, name string")
    root = scratch_path(spark, "precut")
    cut.write.parquet(f"{root}/windows")
    names.write.parquet(f"{root}/names")
    return R.read_unimib(spark, root).select("recording_id", "timestamp", F.round("ax", 6).alias("ax"), "unified_label")


@query("s8_quarantine", with_ctes(
    f"SELECT concat({STEM}, '.csv') AS file_path, 'malformed lines' AS reason, count(*) AS n_lines FROM sensor WHERE timestamp // 20 % 61 = 0 GROUP BY 1"
    " UNION ALL SELECT 'broken_r0.csv.gz', 'no readable line', 0"))
def s8(spark, sf_dir):
    """What reading leaves out: lines with a field too many, and a file that is no archive."""
    root = session_files(spark, sf_dir)
    S.write_text_files(spark.createDataFrame([("broken_r0.csv.gz", 0, 0, "no archive")], "file_path string, block_start long, line_id long, value string"), root)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UnreadableFile)
        lines = read_lines(spark, root)
    left = quarantine(with_header(lines, R.SESSION_COLUMNS)).unionByName(unread_files(spark, root, lines))
    return left.withColumn("file_path", F.substring_index("file_path", "/", -1))


HARMONIZED = ("harm", "SELECT dataset_id, subject_id, CASE WHEN subject_id LIKE '%older%' THEN 'older_adult' WHEN subject_id LIKE '%young%' THEN 'young_adult' WHEN subject_id LIKE 'own%' THEN 'unknown' ELSE 'adult' END AS age_group,"
                      " gx IS NOT NULL AS has_gyro, label FROM sensor")
HARM_SQL = "SELECT dataset_id, age_group, has_gyro, label AS unified_label, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects FROM harm GROUP BY 1, 2, 3, 4"


def harmonized(spark, sf_dir):
    rows = sensor_view(spark, sf_dir).withColumnRenamed("label", "unified_label")
    sources = {d: rows.filter(F.col("dataset_id") == d) for d in ("mobiact", "sisfall", "kfall", "own")}
    sources["unimib_shar"] = rows.filter("dataset_id = 'unimib_shar'").drop("gx", "gy", "gz")
    sources["absent"] = lambda: spark.read.parquet(f"{sf_dir}/no-such-source.parquet")
    return R.harmonize(sources)[0]


def harm_summary(df):
    return (df.groupBy("dataset_id", "age_group", "has_gyro", "unified_label", "subject_id").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("dataset_id", "age_group", "has_gyro", "unified_label").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects")))


@query("s9_harmonize", with_ctes(HARM_SQL, HARMONIZED))
def s9(spark, sf_dir):
    return harm_summary(harmonized(spark, sf_dir))


@query("s10_harmonized_cache", with_ctes(HARM_SQL, HARMONIZED))
def s10(spark, sf_dir):
    path = scratch_path(spark, "harmonized")
    S.cached(spark, path, lambda: harmonized(spark, sf_dir))
    return harm_summary(S.cached(spark, path, lambda: None))


@query("s11_session_csv", with_ctes("SELECT label, count(*) AS n_rows, " + r6("sum(ax)", "sum_ax") + ", min(timestamp) AS first_ts FROM clean GROUP BY 1"))
def s11(spark, sf_dir):
    path = scratch_path(spark, "activity")
    S.write_session_csv(clean_samples(spark, sf_dir), path)
    back = R.session_rows(R.L.read_lines(spark, path), segments=False)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("ax"), 6).alias("sum_ax"), F.min("timestamp").alias("first_ts"))


def archived(spark, sf_dir):
    peak = F.array_max(F.transform("samples", lambda s: F.sqrt(s["ax"] * s["ax"] + s["ay"] * s["ay"] + s["az"] * s["az"])))
    falls = windows(spark, sf_dir).filter("label = 'falling'").withColumns({
        "impact_peak": peak, "confirmed_at": F.element_at("samples.timestamp", -1) + 20, "confirmed": F.col("k") % 2 == 0})
    return S.archive_rows(falls)


ARCHIVE_SQL = ("arch", "SELECT timestamp - timestamp + stop + 20 - (100 - spot) * 20 AS ts, k % 2 = 0 AS confirmed, ax, peak FROM wrow JOIN"
                       " (SELECT recording_id, segment, k, max(timestamp) AS stop, max(sqrt(ax*ax+ay*ay+az*az)) AS peak FROM wrow GROUP BY 1, 2, 3) USING (recording_id, segment, k) WHERE label = 'falling'")


@query("s12_fall_archive", with_ctes(
    "SELECT CASE WHEN confirmed THEN 'FALL_CONFIRMED' ELSE 'EVENT' END AS status, count(*) AS n_rows, " + r6("sum(ax)", "sum_ax") + ", min(ts) AS first_ts, "
    + r6("max(peak)", "top_peak") + " FROM arch GROUP BY 1", ARCHIVE_SQL))
def s12(spark, sf_dir):
    path = scratch_path(spark, "archive")
    S.write_archives(archived(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("ax").cast("double")), 6).alias("sum_ax"),
        F.min(F.col("timestamp_ms").cast("long")).alias("first_ts"), F.round(F.max(F.col("impact_peak").cast("double")), 6).alias("top_peak"))


@query("s14_read_archives", with_ctes(
    "SELECT 'falling' AS label, count(*) AS n_rows, " + r6("sum(ax)", "sum_ax") + ", min(ts) AS first_ts FROM arch", ARCHIVE_SQL))
def s14(spark, sf_dir):
    path = scratch_path(spark, "archive")
    S.write_archives(archived(spark, sf_dir), path)
    return R.read_archives(spark, path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("ax"), 6).alias("sum_ax"), F.min("timestamp").alias("first_ts"))


@query("s15_report_files", with_ctes("SELECT dataset_id, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects FROM sensor GROUP BY 1"))
def s15(spark, sf_dir):
    report = dataset_summary(report_rows(spark, sf_dir))
    as_csv, as_json = scratch_path(spark, "report-csv"), scratch_path(spark, "report-json")
    S.write_report(report, as_csv)
    S.write_report(report, as_json, "json")
    left = spark.read.schema(report.schema).option("header", True).csv(as_csv).select("dataset_id", "n_rows")
    right = spark.read.schema(report.schema).json(as_json).select("dataset_id", "n_subjects")
    return left.join(right, "dataset_id")


@query("s16_split_manifest", with_ctes("SELECT subject_id, dataset_id, split FROM split", *SPLIT))
def s16(spark, sf_dir):
    path = scratch_path(spark, "split")
    rows = sensor_view(spark, sf_dir)
    S.frozen_split(rows, path)
    return S.frozen_split(rows.limit(0), path)  # frozen: the stored manifest is read, not redrawn

