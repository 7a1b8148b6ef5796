"""Streaming queries: the derived rows are replayed in two parts with a restart in between, rows near the
cut (equal clocks too) fall into either part, and the result is checked against the SQL of the batch operator."""

from pyspark.sql import functions as F

from gaitframe.operators import detector as D
from gaitframe.operators import features as FE
from gaitframe.operators import models as MO
from gaitframe.operators import windows as W
from gaitframe.plans import experiments as X
from gaitframe.plans.catalog import query
from gaitframe.plans.queries_alerts import ALERTS, ANSWERS, detector_sql, detector_ticks
from gaitframe.plans.queries_models import RULED
from gaitframe.plans.queries_windows import TICKS, device_ticks
from gaitframe.plans.sensor import clean_samples, table, windows
from gaitframe.plans.sql import r6, with_ctes
from gaitframe.schema import ACC, GYR, SENSORS, VALID_LABELS
from gaitframe.session import materialize, scratch_path
from gaitframe.streaming import live as L
from gaitframe.streaming.replay import replay, start_available, stream_session

#: The view's recordings are cut here: the state has to carry over the restart.
CUT_MS = 1_600_000_004_000


def samples(spark, sf_dir):
    return clean_samples(spark, sf_dir).select(F.col("recording_id").alias("device_id"), "timestamp", *SENSORS)


def halves(df, ts="timestamp", cut=CUT_MS, mixed_ms=1_500):
    """Two parts (of a written table), swapped by a digest of the row within ``mixed_ms`` of the cut."""
    df = materialize(df, "stream-source")
    near = F.abs(F.col(ts) - cut) <= mixed_ms
    first = F.when(near, F.xxhash64(F.to_json(F.struct(*df.columns))) % 2 == 0).otherwise(F.col(ts) < cut)
    return [df.filter(first), df.filter(~first)]


@query("s19_live_source", with_ctes("SELECT recording_id AS device_id, count(*) AS n_rows, max(timestamp) AS last_ts FROM clean GROUP BY 1"))
def s19(spark, sf_dir):
    base = scratch_path(spark, "live")
    rows = samples(spark, sf_dir)
    rows.write.parquet(f"{base}/in")
    stream = L.stream_samples(stream_session(spark), f"{base}/in", rows.schema)
    start_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.unix_millis(F.max("event_time")).alias("last_ts"))


@query("r1_stream_fuse", with_ctes(
    "SELECT recording_id AS device_id, timestamp, ax, coalesce(last_value(g IGNORE NULLS) OVER w, 0.0) AS gx FROM"
    " (SELECT recording_id, timestamp, ax, gx, CASE WHEN timestamp % 60 = 0 THEN gx END AS g FROM clean)"
    " WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def r1(spark, sf_dir):
    rows = samples(spark, sf_dir)

    def feed(name, channels, df):
        return df.select("device_id", "timestamp", F.lit(name).alias("sensor"), *[F.col(c).alias(x) for c, x in zip(channels, "xyz")])

    both = feed("acc", ACC, rows).unionByName(feed("gyr", GYR, rows.filter(F.col("timestamp") % 60 == 0)))
    return replay(halves(both), L.stream_fuse, "fuse", close="timestamp").select("device_id", "timestamp", "ax", "gx")


def replayed_ticks(spark, sf_dir):
    return FE.with_device_flags(replay(halves(samples(spark, sf_dir)), L.stream_ticks, "ticks", close="timestamp"))


@query("r2_stream_ticks", with_ctes(
    "SELECT recording_id AS device_id, tick, tick_ts, " + ", ".join(r6(c, c) for c in ("acc_peak", "acc_min", "gyr_peak", "acc_std")) + ", "
    + r6("even_var", "even_acc_var") + " FROM ticks", *TICKS))
def r2(spark, sf_dir):
    names = ("acc_peak", "acc_min", "gyr_peak", "acc_std", "even_acc_var")
    return replayed_ticks(spark, sf_dir).select("device_id", "tick", "tick_ts", *[F.round(c, 6).alias(c) for c in names])


@query("r3_stream_gates", with_ctes(
    "SELECT recording_id AS device_id, tick, still_ticks, CASE WHEN still_ticks > 2 THEN 'rest' WHEN tick % 2 = 0 AND ge THEN 'gentle' ELSE 'model' END AS gate,"
    " CASE WHEN still_ticks > 2 THEN posture WHEN tick % 2 = 0 AND ge THEN 'walking' ELSE 'running' END AS label FROM runs", *RULED))
def r3(spark, sf_dir):
    ticks = device_ticks(spark, sf_dir).select(
        F.col("recording_id").alias("device_id"), "tick", "tick_ts", "posture",
        ((F.col("even_acc_var") < 60) & (F.col("even_gyr_l1") < 6)).alias("stationary"),
        ((F.col("even_acc_max") < 40) & (F.col("even_acc_min") > 1)).alias("gentle"), (F.col("tick") % 2 == 0).alias("low_power"),
        F.lit("running").alias("model_label"), F.array(*[F.lit(0.5 if c == "running" else 0.1) for c in VALID_LABELS]).alias("model_probs"))
    return replay(halves(ticks, "tick_ts"), L.stream_gates, "gates", close="tick_ts").select("device_id", "tick", "still_ticks", "gate", "label")


@query("r3_live_model", with_ctes("SELECT recording_id AS device_id, count(*) AS n_ticks, 0 AS n_differing FROM ticks GROUP BY 1", *TICKS))
def r3_model(spark, sf_dir):
    """Samples to windows, features and a model's label in one stream; labels that differ from those of the batch are counted."""
    model = MO.fit_tree(X.holdout(X.feature_vectors(windows(spark, sf_dir)))[0], 6)
    live = replay(halves(samples(spark, sf_dir)), lambda s: L.classify_ticks(L.stream_ticks(s, features="features_134"), model), "model", close="timestamp")
    batch = W.inference_ticks(clean_samples(spark, sf_dir), 400, slice_ms=None,
                              extra=[F.sort_array(F.collect_list(F.struct("at", "timestamp", *SENSORS))).alias("samples")])
    labels = MO.predict(model, MO.with_vector(FE.extract_features(batch))).select(F.col("recording_id").alias("device_id"), "tick", "prediction")
    return live.join(labels, ["device_id", "tick"], "full").groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.count_if(~F.col("model_label").eqNullSafe(F.col("prediction"))).alias("n_differing"))


@query("r4_stream_confirm", detector_sql("balanced").replace("SELECT recording_id, t AS tick_ts", "SELECT recording_id AS device_id, t AS tick_ts"))
def r4(spark, sf_dir):
    ticks = detector_ticks(spark, sf_dir).select(F.col("recording_id").alias("device_id"), *D.TICK_COLUMNS)
    trace = replay(halves(ticks, "tick_ts"), lambda s: L.stream_confirm(s, D.preset("balanced")), "confirm", close="tick_ts")
    return trace.select("device_id", "tick_ts", "phase", "still")


@query("r6_stream_escalation", with_ctes(
    "SELECT id, CASE WHEN at_ms <= timestamp + 21600000 THEN at_ms ELSE timestamp + 21600000 END AS decided_at,"
    " CASE WHEN at_ms <= timestamp + 21600000 AND action = 'dismiss' THEN 'DISMISSED_SAFE' WHEN at_ms <= timestamp + 21600000 AND action = 'stop' THEN 'CANCELLED_EARLY'"
    " ELSE 'SOS_DISPATCHED' END AS outcome FROM (SELECT a.id, a.timestamp, (SELECT min(at_ms) FROM answers r WHERE r.device_id = a.device_id AND r.at_ms >= a.timestamp) AS at_ms,"
    " (SELECT first(action ORDER BY at_ms) FROM answers r WHERE r.device_id = a.device_id AND r.at_ms >= a.timestamp) AS action FROM alerts a)", ALERTS, ANSWERS))
def r6_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase', 'signup', 'error')")
    kind = F.col("event_type")
    action = F.when(kind == "error", "alert").when(kind == "click", "dismiss").when(kind == "purchase", "sos").otherwise("stop")
    feed = events.select(F.col("user_id").alias("device_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                         action.alias("action"), F.col("event_id").cast("string").alias("id"))
    # a last mark far ahead lets event time pass every open countdown
    end = feed.groupBy(F.lit(-1).cast("long").alias("device_id")).agg((F.max("timestamp") + 864_000_000).alias("timestamp")).select(
        "device_id", "timestamp", F.lit("stop").alias("action"), F.lit(None).cast("string").alias("id"))
    middle = 1_705_276_800_000
    first, second = feed.filter(F.col("timestamp") < middle), feed.filter(F.col("timestamp") >= middle)

    def build(stream):
        return L.stream_escalate(stream.withColumn("event_time", F.timestamp_millis("timestamp")), 21_600)

    return replay([first, second, end], build, "escalate").select("id", "decided_at", "outcome")


@query("r13_archive_on_confirm", with_ctes(
    "SELECT 'FALL_CONFIRMED' AS status, count(*) AS n_rows, " + r6("sum(ax)", "sum_ax") + " FROM wrow WHERE label = 'falling'"))
def r13(spark, sf_dir):
    base = scratch_path(spark, "archive-stream")
    falls = windows(spark, sf_dir).filter("label = 'falling'").withColumns({
        "impact_peak": F.array_max("samples.ax"), "confirmed_at": F.element_at("samples.timestamp", -1), "confirmed": F.lit(True)})
    falls.write.parquet(f"{base}/in")
    spark.readStream.schema(falls.schema).parquet(f"{base}/in").writeStream.foreachBatch(L.archive_batches(f"{base}/out")).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("header", True).csv(f"{base}/out").groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("ax").cast("double")), 6).alias("sum_ax"))


def label_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("event_type").alias("label"),
                                                   F.col("ts").cast("timestamp").alias("event_time"))
    mark = events.agg((F.max("event_time") + F.expr("interval 90 days")).alias("event_time")).select(
        F.lit(-1).cast("long").alias("device_id"), F.lit("end").alias("label"), "event_time")
    return [events, mark]


@query("r14_activity_summary", """SELECT user_id AS device_id, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type AS label,
  count(*) AS n_ticks FROM events GROUP BY 1, 2, 3, 4""")
def r14(spark, sf_dir):
    out = replay(label_stream(spark, sf_dir), lambda s: L.activity_summary(s, "1 day"), "summary").filter("device_id >= 0")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("r14_activity_sessions", """SELECT user_id AS device_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n_ticks FROM (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS c FROM events)) GROUP BY 1, s""")
def r14_sessions(spark, sf_dir):
    out = replay(label_stream(spark, sf_dir), lambda s: L.activity_sessions(s, "6 hours"), "sessions").filter("device_id >= 0")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})

