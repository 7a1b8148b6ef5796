"""Queries over alerts, escalation and the batch fall detector. Alerts come from ``events``."""

from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators import alerts as L
from gaitframe.operators import detector as D
from gaitframe.operators import joins as J
from gaitframe.plans.catalog import query
from gaitframe.plans.queries_windows import TICKS, device_ticks
from gaitframe.plans.sensor import clean_samples, table
from gaitframe.plans.sql import with_ctes

DAY_MS = 86_400_000

# Alerts of the events table: one per 'error' event.
ALERTS = ("alerts", """SELECT CAST(event_id AS VARCHAR) AS id, user_id AS device_id, epoch_us(ts) // 1000 AS timestamp,
  CASE event_id % 4 WHEN 0 THEN 'DISMISSED_SAFE' WHEN 1 THEN 'SOS_DISPATCHED' WHEN 2 THEN 'CANCELLED_EARLY' ELSE 'DISMISSED_SAFE' END AS outcome,
  concat('event ', CAST(event_id AS VARCHAR)) AS summary,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 180 - 90 + 0.5 END AS latitude,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 360 - 180 + 0.25 END AS longitude,
  value AS impact FROM events WHERE event_type = 'error'""")


def alerts(spark, sf_dir):
    e = F.col("event_id")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("DISMISSED_SAFE", "SOS_DISPATCHED", "CANCELLED_EARLY", "no such outcome")]), (e % 4 + 1).cast("int"))
    nowhere = e % 3 == 0
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("device_id"), e.cast("string").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), outcome.alias("outcome"),
        F.concat(F.lit("event "), e.cast("string")).alias("summary"),
        F.when(nowhere, None).otherwise(e % 180 - 90 + 0.5).alias("latitude"),
        F.when(nowhere, None).otherwise(e % 360 - 180 + 0.25).alias("longitude"), F.col("value").alias("impactForce"),
        F.lit(38.0).alias("tiltAngle"), (e % 100).cast("int").alias("confidencePct"), F.lit("walking").alias("activityBeforeFall"))


@query("s17_alert_json", with_ctes(
    "SELECT device_id, id, timestamp, outcome, summary, latitude, longitude, impact AS \"impactForce\" FROM"
    " (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY timestamp DESC, id) AS r FROM alerts) WHERE r <= 100", ALERTS))
def s17(spark, sf_dir):
    stored = L.alerts_to_json(alerts(spark, sf_dir))
    return L.parse_alerts(stored).select("device_id", "id", "timestamp", "outcome", "summary", "latitude", "longitude", "impactForce")


CONTACTS = ("contacts", """SELECT c_custkey // 4 AS device_id, c_custkey % 4 AS position, c_name AS name,
  concat(CAST(c_nationkey + 10 AS VARCHAR), CAST(c_custkey AS VARCHAR)) AS phone FROM customer""")


def contacts_json(spark, sf_dir):
    """Four customers make a device's contact list, badly typed."""
    key = F.col("c_custkey")
    one = F.struct(key.cast("string").alias("id"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"),
                   F.concat(F.lit(" "), (F.col("c_nationkey") + 10).cast("string"), F.lit("-"), key.cast("string"), F.lit(" ")).alias("phone"))
    rows = table(spark, sf_dir, "customer").select(F.floor(key / 4).alias("device_id"), (key % 4).alias("p"), one.alias("c"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p", "c"))), lambda x: x["c"])
    return rows.groupBy("device_id").agg(F.to_json(listed).alias("contacts_json"))


@query("s18_contacts", with_ctes("SELECT device_id, CAST(position AS INTEGER) AS position, name, phone FROM contacts", CONTACTS))
def s18(spark, sf_dir):
    return L.parse_contacts(contacts_json(spark, sf_dir)).select("device_id", "position", "name", "phone")


@query("j7_escalation_messages", with_ctes(
    "SELECT a.id, c.phone, c.name, 'sms' AS kind FROM alerts a JOIN contacts c USING (device_id) UNION ALL"
    " SELECT a.id, c.phone, c.name, 'call' FROM alerts a JOIN contacts c USING (device_id) WHERE c.position = 0", ALERTS, CONTACTS))
def j7(spark, sf_dir):
    people = L.parse_contacts(contacts_json(spark, sf_dir))
    return L.escalation_messages(alerts(spark, sf_dir), people).select("id", "phone", "name", "kind")


@query("j7_dispatch_summary", with_ctes(
    "SELECT device_id, concat('SOS Dispatched: Call initiated to ', first(name ORDER BY position), '. SMS sent to ', count(*), ' of ', count(*), ' contacts.') AS summary"
    " FROM contacts GROUP BY 1", CONTACTS))
def j7_summary(spark, sf_dir):
    return L.dispatch_summary(L.parse_contacts(contacts_json(spark, sf_dir)))


@query("j8_low_power", """SELECT event_id, pct AS battery_pct, pct <= 20 AND NOT charging AS low_power FROM (
  SELECT event_id, event_type, coalesce(last_value(CASE WHEN event_type = 'view' THEN CAST(floor(least(value, 100.0) * 100 / 100) AS INTEGER) END IGNORE NULLS) OVER w, 50) AS pct,
    coalesce(last_value(CASE WHEN event_type = 'view' THEN event_id % 5 = 0 END IGNORE NULLS) OVER w, false) AS charging
  FROM events WHERE event_type IN ('view', 'click')
  WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE event_type = 'click'""")
def j8(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))
    ticks = events.filter("event_type = 'click'").select("event_id", F.col("user_id").alias("device_id"), "timestamp")
    battery = events.filter("event_type = 'view'").select(
        F.col("user_id").alias("device_id"), "timestamp", F.least("value", F.lit(100.0)).alias("level"), F.lit(100).alias("scale"),
        (F.col("event_id") % 5 == 0).alias("charging"))
    return J.low_power_flag(ticks, battery).select("event_id", "battery_pct", "low_power")


ANSWERS = ("answers", "SELECT user_id AS device_id, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'click' THEN 'dismiss' WHEN 'purchase' THEN 'sos' ELSE 'stop' END AS action"
                      " FROM events WHERE event_type IN ('click', 'purchase', 'signup')")


@query("r6_escalation", with_ctes(
    "SELECT id, CASE WHEN at_ms <= timestamp + 21600000 THEN at_ms ELSE timestamp + 21600000 END AS decided_at,"
    " CASE WHEN at_ms <= timestamp + 21600000 AND action = 'dismiss' THEN 'DISMISSED_SAFE' WHEN at_ms <= timestamp + 21600000 AND action = 'stop' THEN 'CANCELLED_EARLY'"
    " ELSE 'SOS_DISPATCHED' END AS outcome FROM (SELECT a.id, a.timestamp, (SELECT min(at_ms) FROM answers r WHERE r.device_id = a.device_id AND r.at_ms >= a.timestamp) AS at_ms,"
    " (SELECT first(action ORDER BY at_ms) FROM answers r WHERE r.device_id = a.device_id AND r.at_ms >= a.timestamp) AS action FROM alerts a)", ALERTS, ANSWERS))
def r6_escalation(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase', 'signup')")
    action = F.when(F.col("event_type") == "click", "dismiss").when(F.col("event_type") == "purchase", "sos").otherwise("stop")
    answers = events.select(F.col("user_id").alias("device_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), action.alias("action"))
    confirmed = alerts(spark, sf_dir).drop("outcome")
    return L.escalate(confirmed, answers, countdown_s=21_600, slice_ms=7 * DAY_MS).select("id", "decided_at", "outcome")


@query("r7_sos_body", with_ctes(
    "SELECT id, concat('EMERGENCY SOS: Fall detected by motion monitor! User did not respond to check-in. Time: ',"
    " strftime(make_timestamp(timestamp * 1000), '%H:%M:%S %d-%b'), '. Location: ', CASE WHEN latitude IS NULL THEN 'Location unavailable'"
    " ELSE concat('https://maps.google.com/?q=', CAST(CAST(latitude AS DOUBLE) AS VARCHAR), ',', CAST(CAST(longitude AS DOUBLE) AS VARCHAR)) END, '. Please call or assist immediately!') AS body FROM alerts", ALERTS))
def r7(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude")})
    return L.with_sos_body(rows).select("id", "body")


@query("r7_newest_fix", """SELECT user_id, first(value ORDER BY epoch_us(ts) // 1000 DESC, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END DESC) AS latitude
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def r7_fix(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')")
    fixes = events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("fix_ts"),
                          F.when(F.col("event_type") == "view", "network").otherwise("gps").alias("provider"),
                          F.col("value").alias("latitude"), F.col("value").alias("longitude"))
    return L.newest_fix(fixes, ["user_id"]).select("user_id", "latitude")


@query("r8_alert_history", with_ctes(
    "SELECT device_id, id, CAST(place AS INTEGER) AS place, CASE outcome WHEN 'DISMISSED_SAFE' THEN 'Safety Check-In' WHEN 'SOS_DISPATCHED' THEN 'Emergency SOS Dispatched'"
    " ELSE 'False Motion Filtered' END AS title FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY timestamp DESC, id) AS place FROM alerts) WHERE place <= 5", ALERTS))
def r8(spark, sf_dir):
    stored = alerts(spark, sf_dir).withColumn("outcome", F.when(F.col("outcome") == "no such outcome", "DISMISSED_SAFE").otherwise(F.col("outcome")))
    return L.alert_history(stored, 5).select("device_id", "id", "place", "title")


@query("t3_top_per_device", """SELECT user_id AS device_id, CAST(event_id AS VARCHAR) AS id, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, CAST(event_id AS VARCHAR)) AS place FROM events) WHERE place <= 100""")
def t3(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"), F.col("event_id").cast("string").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("DISMISSED_SAFE").alias("outcome"))
    return L.alert_history(rows, 100).select("device_id", "id", "place")


@query("r9_relative_age", with_ctes(
    "SELECT id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN concat(m, ' min ago') WHEN m // 60 < 24 THEN concat(m // 60, ' hr ago')"
    " WHEN m // 1440 = 1 THEN 'Yesterday' ELSE concat(m // 1440, ' days ago') END AS age FROM (SELECT id, (1706659200000 - timestamp) // 60000 AS m FROM alerts)", ALERTS))
def r9(spark, sf_dir):
    return L.with_relative_age(alerts(spark, sf_dir), F.lit(1706659200000)).select("id", "age")


@query("r10_calibration", with_ctes(
    "SELECT recording_id, timestamp, round(peak, 6) AS peak, peak >= 26 AS high_impact FROM (SELECT recording_id, timestamp,"
    " greatest(9.8::DOUBLE, max(acc) OVER (PARTITION BY recording_id, grp ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM"
    " (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS acc, sum(CASE WHEN timestamp % 3000 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY timestamp"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM clean))"))
def r10(spark, sf_dir):
    rows = clean_samples(spark, sf_dir).select("recording_id", "timestamp", C.acc_magnitude().alias("acc"), (F.col("timestamp") % 3000 == 0).alias("reset"))
    return L.calibrate(rows).select("recording_id", "timestamp", F.round("peak", 6).alias("peak"), "high_impact")


# The emitted rows as a recursion: each is the first at least 100 ms (or another interval) after the one before.
def throttle_sql(source, key, clock, value, every):
    return (f"WITH RECURSIVE src AS ({source}), emitted AS (SELECT {key}, min({clock}) AS {clock} FROM src GROUP BY 1 UNION ALL SELECT e.{key},"
            f" (SELECT min(s.{clock}) FROM src s WHERE s.{key} = e.{key} AND s.{clock} >= e.{clock} + {every}) AS {clock} FROM emitted e WHERE e.{clock} IS NOT NULL)"
            f" SELECT {key}, {clock}, min({value}) AS {value} FROM src JOIN emitted USING ({key}, {clock}) GROUP BY 1, 2")


@query("r11_throttle", throttle_sql(with_ctes("SELECT recording_id, timestamp, round(sqrt(ax*ax + ay*ay + az*az), 6) AS acc FROM clean"), "recording_id", "timestamp", "acc", 100))
def r11(spark, sf_dir):
    rows = clean_samples(spark, sf_dir).select("recording_id", "timestamp", F.round(C.acc_magnitude(), 6).alias("acc"))
    return L.throttle(rows)


@query("r11_throttle_events", throttle_sql("SELECT user_id, epoch_ms(ts) // 60000 AS minute, event_id FROM events", "user_id", "minute", "event_id", 360))
def r11_events(spark, sf_dir):
    """An irregular clock: one event per user and six hours, by the minute."""
    minute = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60_000).alias("minute")
    return L.throttle(table(spark, sf_dir, "events").select("user_id", minute, "event_id"), 360, ["user_id"], "minute", slice_ms=14_400)


@query("r12_recording_progress", with_ctes(
    "SELECT recording_id, timestamp, n AS samples, (timestamp - began) // 1000 AS seconds, printf('%02d:%02d', (timestamp - began) // 60000, (timestamp - began) // 1000 % 60) AS elapsed FROM"
    " (SELECT recording_id, timestamp, row_number() OVER w AS n, min(timestamp) OVER (PARTITION BY recording_id) AS began FROM clean WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp)) WHERE n % 10 = 0"))
def r12(spark, sf_dir):
    return L.recording_progress(clean_samples(spark, sf_dir), slice_ms=None)


def detector_ticks(spark, sf_dir):
    """Ticks with a label from the impact and the tilt, no model involved."""
    ticks = device_ticks(spark, sf_dir)
    label = F.when(F.col("acc_peak") > 20, "falling").when(F.abs("mean_az") > 9, "lying").otherwise("sitting")
    return D.as_ticks(ticks, label, p_fall=F.when(F.col("acc_peak") > 20, 0.6).otherwise(0.1))


# The detector as a recursion over the ticks of a recording: idle 0, phases 1 to 3, confirmed 4.
DETECT = (
    *TICKS,
    ("dt", "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY tick_ts) AS n, tick_ts AS t, acc_peak AS pk, acc_min AS lo, gyr_peak AS gp, acc_std AS sd,"
           " mx / sqrt(mx*mx+my*my+mz*mz) AS ox, my / sqrt(mx*mx+my*my+mz*mz) AS oy, mz / sqrt(mx*mx+my*my+mz*mz) AS oz,"
           " acc_peak > 20 AS fall, NOT acc_peak > 20 AND abs(mz) > 9 AS lying FROM ticks"),
    ("rec", """SELECT recording_id, 0 AS n, CAST(0 AS BIGINT) AS t, 0 AS ph, CAST(0 AS BIGINT) AS e, 0 AS still, 0.0::DOUBLE AS gx, 1.0::DOUBLE AS gy, 0.0::DOUBLE AS gz FROM dt GROUP BY 1
  UNION ALL SELECT recording_id, n, t, nph, CASE WHEN nph <> ph OR (nph = 1 AND pk > {spike}) THEN CASE WHEN nph = 0 THEN 0 ELSE t END ELSE e END,
    CASE WHEN nph = 3 AND ph = 3 THEN CASE WHEN rest THEN still + 1 WHEN sd > 2 THEN 0 ELSE still END ELSE 0 END,
    CASE WHEN upd THEN ox ELSE gx END, CASE WHEN upd THEN oy ELSE gy END, CASE WHEN upd THEN oz ELSE gz END
  FROM (SELECT *, ph = 0 AND NOT fall AND sd < 2 AS upd, CASE ph
      WHEN 0 THEN CASE WHEN {start} THEN 1 ELSE 0 END
      WHEN 1 THEN CASE WHEN t - e > 2500 THEN 0 WHEN gp > 1.8 THEN 2 ELSE 1 END
      WHEN 2 THEN CASE WHEN t - e > 2500 THEN 0 WHEN fall AND pk > 0.75 * {spike} THEN 3 ELSE 2 END
      WHEN 3 THEN CASE WHEN t - e > 4500 THEN 0 WHEN rest AND still + 1 >= {still} THEN 4 ELSE 3 END ELSE 4 END AS nph
    FROM (SELECT r.recording_id, d.n, d.t, r.ph, r.e, r.still, r.gx, r.gy, r.gz, d.pk, d.lo, d.gp, d.sd, d.ox, d.oy, d.oz, d.fall,
        d.lying OR (d.sd < 1.2 AND degrees(acos(greatest(least(r.gx*d.ox + r.gy*d.oy + r.gz*d.oz, 1.0), -1.0))) >= {tilt}) AS rest
      FROM rec r JOIN dt d ON d.recording_id = r.recording_id AND d.n = r.n + 1))"""),
)
PHASE = "CASE ph WHEN 0 THEN 'IDLE' WHEN 1 THEN 'PHASE1_SUDDEN_MOVEMENT' WHEN 2 THEN 'PHASE2_ROTATION' WHEN 3 THEN 'PHASE3_IMPACT' ELSE 'CONFIRMED' END"


def detector_sql(name):
    spike, freefall, dip, _, tilt, still = D.preset(name)
    start = (f"lo < {freefall} AND pk >= 0.75 * {spike}" if dip else f"pk > {spike} OR (lo < {freefall} AND gp > 1.2)")
    text = with_ctes(f"SELECT recording_id, t AS tick_ts, {PHASE} AS phase, still FROM rec WHERE n > 0", *DETECT)
    for key, value in {"spike": spike, "start": start, "still": still, "tilt": tilt}.items():
        text = text.replace("{" + key + "}", str(value))
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def detect(name):
    # a recording of this view is 10 s long, so a confirmed fall stays confirmed to its end
    @query(f"r4_confirm_falls_{name}", detector_sql(name))
    def run(spark, sf_dir):
        trace = D.confirm_falls(detector_ticks(spark, sf_dir), D.preset(name), slice_ms=None)
        return trace.select("recording_id", "tick_ts", "phase", "still")


for _name in ("desk_safe", "balanced", "high", "custom"):
    detect(_name)


@query("r5_presets", with_ctes(
    "SELECT preset, count(*) FILTER (acc_peak > spike) AS impacts, count(*) AS n_ticks FROM ticks,"
    " (VALUES ('desk_safe', 26), ('balanced', 22), ('high', 18), ('custom', 24)) p(preset, spike) GROUP BY 1", *TICKS))
def r5(spark, sf_dir):
    # every tick against each of the four presets: a fixed factor, unrolled from a constant array
    limits = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(D.preset(n)[0]).alias("spike"))
                                 for n in ("desk_safe", "balanced", "high", "custom")])).alias("p")
    return device_ticks(spark, sf_dir).select("acc_peak", limits).groupBy("p.preset").agg(
        F.count_if(F.col("acc_peak") > F.col("p.spike")).alias("impacts"), F.count(F.lit(1)).alias("n_ticks"))

