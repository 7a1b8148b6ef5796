"""Fall scenarios with all presets, the batch twin, and streams over several micro-batches."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaitframe.operators import detector as D
from gaitframe.operators import features as FE
from gaitframe.operators import windows as W
from gaitframe.schema import SENSORS
from gaitframe.session import materialize
from gaitframe.streaming import live as L
from gaitframe.streaming.replay import replay, start_available, stream_session

PI2 = 2 * math.pi


def walk(n=300):
    rows = []
    for i in range(n):
        t = i * 0.02
        rows.append((1.2 * math.sin(PI2 * 0.9 * t), 9.81 + 3.2 * math.sin(PI2 * 1.8 * t), 0.8 * math.cos(PI2 * 1.8 * t),
                     0.4 * math.sin(PI2 * 1.8 * t), 0.3 * math.cos(PI2 * 0.9 * t), 0.2 * math.sin(PI2 * 1.8 * t)))
    return rows


def drop(resumed=50):
    rows = [(0, 9.81, 0, 0, 0, 0)] * 50 + [(0.2, 0.5, 0.1, 0.5, 0.2, 0.3)] * 15 + [(25, 35, 20, 4, 3.5, 2)] * 2
    return rows + [(2 * math.cos(PI2 * 1.5 * i * 0.02), 9.81 + 4 * math.sin(PI2 * 1.5 * i * 0.02), 1, 1.5, 1.2, 0.8) for i in range(resumed)]


def fall(lying=150):
    return ([(0.1, 9.75, 0.8, 0, 0, 0)] * 50 + [(1, 3.2, 1.5, 2.8, 2.2, 2.5)] * 20 + [(14, 24.5, 12, 3.5, 2.8, 2.2)] * 12
            + [(0.1, 0.2, 9.81, 0.02, 0.01, 0.01)] * lying)


SCENARIOS = {"walk": walk(), "drop": drop(), "drop_long": drop(250), "fall": fall(), "fall_long": fall(300)}


def label_of(name, end, block):
    if name.startswith("drop"):
        return "falling" if end <= 140 else "walking"
    if name == "walk":
        return "walking"
    svm = np.sqrt((block[:, :3] ** 2).sum(1))
    return "falling" if svm.max() > 20 else "lying" if svm.std() < 0.05 else "walking"


def ticks_of(name):
    data = np.array(SCENARIOS[name], dtype=float)
    out = []
    for end in range(100, len(data) + 1, 20):
        block = data[end - 100:end]
        m = L.tick_metrics(block[None])
        mean = np.array([m["mean_ax"][0], m["mean_ay"][0], m["mean_az"][0]])
        out.append((name, end * 20, label_of(name, end, block), 0.0, 0.0, m["acc_peak"][0], m["acc_min"][0], m["gyr_peak"][0], m["acc_std"][0],
                    *(mean / np.linalg.norm(mean))))
    return pd.DataFrame(out, columns=["device_id", *D.TICK_COLUMNS])


def changes(trace):
    moved = trace[trace["from_phase"] != trace["phase"]]
    return [(int(t) // 20, p.split("_")[0]) for t, p in zip(moved["tick_ts"], moved["phase"])]


EXPECTED = {
    ("walk", "any"): [],
    ("drop", "any"): [(100, "PHASE1")],
    ("drop_long", "desk_safe"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (160, "IDLE")],
    ("drop_long", "custom"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (160, "IDLE")],
    ("fall", "desk_safe"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3")],
    ("fall", "balanced"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (220, "CONFIRMED")],
    ("fall", "high"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (220, "CONFIRMED")],
    ("fall", "custom"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3")],
    ("fall_long", "desk_safe"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (240, "CONFIRMED")],
    ("fall_long", "balanced"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (220, "CONFIRMED")],
    ("fall_long", "high"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (220, "CONFIRMED")],
    ("fall_long", "custom"): [(100, "PHASE1"), (120, "PHASE2"), (140, "PHASE3"), (260, "CONFIRMED")],
}


@pytest.mark.parametrize("preset", ["desk_safe", "balanced", "high", "custom"])
def test_scenarios(preset):
    for name in SCENARIOS:
        _, trace = D.run_ticks(D.START, ticks_of(name), D.preset(preset))
        got = changes(trace)
        if name == "drop_long" and preset in ("balanced", "high"):
            assert got[:4] == EXPECTED[(name, "desk_safe")] and got[4:6] == [(180, "PHASE1"), (200, "PHASE2")]
            assert "CONFIRMED" not in [p for _, p in got]
        else:
            assert got == EXPECTED.get((name, preset), EXPECTED.get((name, "any"))), (name, preset)


def random_ticks(n, seed, devices=2):
    """Bursts of violent ticks between long calm stretches, and some falls that get confirmed."""
    rng = np.random.default_rng(seed)
    out = []
    for d in range(devices):
        t = 0
        while len(out) < (d + 1) * n:
            for _ in range(int(rng.integers(3, 14))):       # burst
                t += int(rng.choice([400, 800, 1000]))
                peak = float(rng.choice([10, 18, 24, 30]))
                label = str(rng.choice(["falling", "lying", "walking", "sitting"]))
                o = rng.normal(size=3)
                out.append((f"d{d}", t, label, float(rng.random() * 0.5), float(rng.random() * 0.5), peak, float(rng.uniform(3, 9)),
                            float(rng.uniform(0, 4)), float(rng.uniform(0, 4)), *(o / np.linalg.norm(o))))
            for _ in range(int(rng.integers(0, 130))):      # calm
                t += int(rng.choice([400, 1000]))
                o = rng.normal(size=3)
                out.append((f"d{d}", t, "sitting", 0.0, 0.0, 10.0, 9.5, 0.1, float(rng.uniform(0, 3)), *(o / np.linalg.norm(o))))
    return pd.DataFrame(out, columns=["device_id", *D.TICK_COLUMNS])


@pytest.mark.parametrize("preset", ["desk_safe", "balanced"])
def test_episodes_equal_one_long_run(spark, preset):
    ticks, limits = random_ticks(1500, 5), D.preset(preset)
    want = pd.concat([D.run_ticks(D.START, g.sort_values("tick_ts"), limits, 30_000)[1].assign(device_id=d) for d, g in ticks.groupby("device_id")])
    df = spark.createDataFrame(ticks)
    assert D.episodes(df, limits, ["device_id"], 30_000, 60_000).select("device_id", "episode").distinct().count() > 8
    got = D.confirm_falls(df, limits, ["device_id"], slot_ms=60_000).toPandas()
    key = ["device_id", "tick_ts"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert (a["phase"] == b["phase"]).all() and (a["still"] == b["still"]).all() and len(a) == len(b)
    assert D.confirmations(spark.createDataFrame(want)).count() > 0


def test_a_device_that_never_calms(spark):
    """A million ticks in one episode pass in order through one partition; a second device with a null name beside it."""
    n = 1_000_000
    i = F.col("id")
    ticks = spark.range(0, n, 1, 8).select(
        F.lit("d").alias("device_id"), (i * 400).alias("tick_ts"), F.when(i % 7 < 3, "falling").otherwise("walking").alias("label"),
        (i % 5 / 10).alias("p_fall"), F.lit(0.0).alias("p_lying"), (F.lit(20.0) + i % 11).alias("acc_peak"), F.lit(4.0).alias("acc_min"),
        (i % 3).cast("double").alias("gyr_peak"), (i % 4).cast("double").alias("acc_std"), F.lit(0.0).alias("ox"), F.lit(1.0).alias("oy"), F.lit(0.0).alias("oz"))
    limits = D.preset("balanced")
    both = ticks.unionByName(ticks.limit(50).withColumn("device_id", F.lit(None).cast("string")))
    assert D.episodes(both, limits, ["device_id"], 30_000).select("device_id", "episode").distinct().count() == 2
    got = materialize(D.confirm_falls(both, limits, ["device_id"]), "never-calm")
    _, head = D.run_ticks(D.START, ticks.filter(i < 5_000).toPandas(), limits, 30_000)
    first = got.filter("device_id = 'd' AND tick_ts < 2000000").orderBy("tick_ts").toPandas()
    assert (first[head.columns] == head).all().all() and len(first) == 5_000
    counts = {r["device_id"]: r["n"] for r in got.groupBy("device_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"d": n, None: 50}


def test_stream_detector_equals_batch_over_many_batches(spark):
    ticks, limits = random_ticks(400, 11), D.preset("balanced")
    df = spark.createDataFrame(ticks)
    cuts = [0, 60_000, 61_000, 200_000, 10**9]
    parts = [df.filter((F.col("tick_ts") >= a) & (F.col("tick_ts") < b)) for a, b in zip(cuts, cuts[1:])]
    got = replay(parts, lambda s: L.stream_confirm(s, limits), "t-confirm", close="tick_ts").toPandas()
    want = pd.concat([D.run_ticks(D.START, g.sort_values("tick_ts"), limits, 30_000)[1].assign(device_id=d) for d, g in ticks.groupby("device_id")])
    a, b = (x.sort_values(["device_id", "tick_ts"]).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and (a["phase"] == b["phase"]).all()


#: Clocks of the streamed samples begin here: the first watermark of a stream is the epoch.
BEGAN = 1_600_000_000_000


def sample_frame(spark, n=700):
    rng = np.random.default_rng(3)
    rows = [("d", BEGAN + 20 * i, *map(float, rng.normal(size=6))) for i in range(n)]
    return spark.createDataFrame(rows, "device_id string, timestamp long, " + ", ".join(f"{c} double" for c in SENSORS))


def test_stream_ticks_equal_batch_ticks(spark):
    df = sample_frame(spark)
    cuts = [BEGAN + c for c in (0, 30, 1_990, 2_000, 2_410, 9_000, 10**9)]
    parts = [df.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b)) for a, b in zip(cuts, cuts[1:])]
    got = FE.with_device_flags(replay(parts, L.stream_ticks, "t-ticks", close="timestamp")).orderBy("tick").toPandas()
    batch = W.inference_ticks(df.withColumnRenamed("device_id", "recording_id"), 400, extra=FE.device_metrics())
    want = FE.with_device_flags(batch).orderBy("tick").toPandas()
    assert got["tick"].tolist() == want["tick"].tolist() and got["tick_ts"].tolist() == want["tick_ts"].tolist()
    for c in ("acc_peak", "acc_min", "gyr_peak", "acc_std", "mean_az", "even_acc_var", "even_gyr_l1"):
        np.testing.assert_allclose(got[c], want[c])
    assert got["posture"].tolist() == want["posture"].tolist()


def test_late_rows_count_within_the_watermark_only(spark):
    """Rows of a later part are used while the watermark (10 s) has not passed them, and dropped beyond it."""
    df = sample_frame(spark, 1200)
    clock = F.col("timestamp") - BEGAN
    late, lost = (clock >= 17_000) & (clock < 17_200), (clock >= 1_000) & (clock < 1_200)
    parts = [df.filter(~late & ~lost), df.filter(late | lost)]
    got = replay(parts, L.stream_ticks, "t-late", close="timestamp").orderBy("tick").toPandas()
    want = FE.with_device_flags(W.inference_ticks(df.filter(~lost).withColumnRenamed("device_id", "recording_id"), 400, extra=FE.device_metrics())).orderBy("tick").toPandas()
    assert got["tick_ts"].tolist() == want["tick_ts"].tolist()
    np.testing.assert_allclose(got["acc_peak"], want["acc_peak"])


def test_fusion_keeps_every_accelerometer_row(spark):
    """Equal clocks split over parts: the gyroscope reading still goes first and no row is lost."""
    rows = [("d", 0, "acc", 1.0), ("d", 20, "gyr", 7.0), ("d", 20, "acc", 2.0), ("d", 40, "acc", 3.0), ("d", 60, "gyr", 8.0), ("d", 60, "acc", 4.0)]
    df = spark.createDataFrame([(d, BEGAN + t, s, x, x, x) for d, t, s, x in rows], "device_id string, timestamp long, sensor string, x double, y double, z double")
    early = (F.col("sensor") == "gyr") | (F.col("timestamp") == BEGAN + 40)
    parts = [df.filter(early), df.filter(~early)]
    got = replay(parts, L.stream_fuse, "t-fuse", close="timestamp").orderBy("timestamp").collect()
    assert [(r.timestamp - BEGAN, r.ax, r.gx) for r in got] == [(0, 1.0, 0.0), (20, 2.0, 7.0), (40, 3.0, 7.0), (60, 4.0, 8.0)]


def test_stream_escalation_waits_for_answer_or_deadline(spark):
    base = 1_700_000_000_000
    rows = [("d", 0, "alert", "a"), ("d", 20_000, "dismiss", None), ("d", 100_000, "alert", "b"), ("d", 200_000, "alert", "c"),
            ("d", 205_000, "sos", None), ("e", 0, "alert", "x"), ("e", 300_000, "stop", None)]
    rows = [(d, base + t, a, i) for d, t, a, i in rows]
    df = spark.createDataFrame(rows, "device_id string, timestamp long, action string, id string")
    parts = [df.filter(F.col("timestamp") < base + 150_000), df.filter((F.col("timestamp") >= base + 150_000) & (F.col("timestamp") < base + 250_000)),
             df.filter(F.col("timestamp") >= base + 250_000)]
    out = replay(parts, lambda s: L.stream_escalate(s.withColumn("event_time", F.timestamp_millis("timestamp")), 30), "t-esc")
    got = {r["id"]: (r["decided_at"] - base, r["outcome"]) for r in out.collect()}
    assert got == {"a": (20_000, "DISMISSED_SAFE"), "b": (130_000, "SOS_DISPATCHED"), "c": (205_000, "SOS_DISPATCHED"), "x": (30_000, "SOS_DISPATCHED")}


def test_what_waits_stands_in_the_state_by_slots(spark, tmp_path):
    """The state's tables hold the rows of one watermark delay, whole slots that have passed are gone, and a column
    name that no named tuple takes keeps its rows."""
    df = sample_frame(spark, 1_000).withColumn("_class", F.lit(1))
    session, base = stream_session(spark), str(tmp_path)
    for part in (df.filter(F.col("timestamp") < BEGAN + 15_000), df.filter(F.col("timestamp") >= BEGAN + 15_000)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        start_available(L.stream_ticks(session.readStream.schema(df.schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint")
    held = session.read.format("statestore").option("stateVarName", "held").load(f"{base}/checkpoint")
    mark = BEGAN + 20 * 999 - 10_000
    first = mark // L.SLOT_MS
    assert {r[0] for r in held.selectExpr("user_map_key.slot").collect()} == set(range(first, (BEGAN + 20 * 999) // L.SLOT_MS + 1))
    now = session.read.format("statestore").option("stateVarName", "now").load(f"{base}/checkpoint").selectExpr("value.*").first()
    assert now.timer == (first + 1) * L.SLOT_MS and now.seen == (first * L.SLOT_MS - BEGAN) // 20
    assert spark.read.parquet(f"{base}/out").agg(F.max("tick_ts")).first()[0] < first * L.SLOT_MS


def test_devices_share_states(spark, tmp_path):
    """Many devices (one without a name) take few states, in several batches, and each gets its own rows in order."""
    i = F.col("id")
    df = spark.range(0, 1_500 * 12, 1, 4).select(
        F.when(i % 1_500 > 0, i % 1_500).alias("device_id"), (F.lit(BEGAN) + F.floor(i / 1_500) * 700 + i % 7).alias("timestamp"),
        F.when(F.floor(i / 1_500) % 3 == 1, "gyr").otherwise("acc").alias("sensor"), *[(i * n).cast("double").alias(c) for n, c in enumerate("xyz", 1)])
    session, base = stream_session(spark), str(tmp_path)
    for part in (df.filter(i % 5 < 2), df.filter(i % 5 >= 2), df.limit(1).withColumn("timestamp", F.lit(BEGAN + 10**6))):
        part.drop("id").write.mode("append").parquet(f"{base}/in")
        start_available(L.stream_fuse(session.readStream.schema(df.schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint")
        assert session.read.format("statestore").option("stateVarName", "now").load(f"{base}/checkpoint").count() <= L.BUCKETS
    got = spark.read.parquet(f"{base}/out").fillna(0, ["device_id"]).toPandas().sort_values(["device_id", "timestamp"], ignore_index=True)
    rows = df.fillna(0, ["device_id"]).toPandas().sort_values(["device_id", "timestamp"], ignore_index=True)
    for c, g in zip("xyz", ("gx", "gy", "gz")):
        rows[g] = rows[c].where(rows["sensor"] == "gyr").groupby(rows["device_id"]).ffill().fillna(0.0)
    want = rows[rows["sensor"] == "acc"].reset_index(drop=True)
    assert len(got) == len(want) == 12_000
    for mine, own in (("device_id", "device_id"), ("timestamp", "timestamp"), ("ax", "x"), ("gx", "gx"), ("gz", "gz")):
        assert (got[mine] == want[own]).all()


def test_a_silent_device_is_forgotten(spark, tmp_path):
    """Devices of one bucket: the state of the one that is silent for an hour of event time goes, the other's stays."""
    buckets = {r.id: r.b for r in spark.range(2_000).select("id", F.pmod(F.xxhash64("id"), F.lit(L.BUCKETS)).alias("b")).collect()}
    one, other = [d for d in buckets if buckets[d] == buckets[0]][:2]
    session, base = stream_session(spark), str(tmp_path)
    for hour, here in ((0, [one, other]), (1, [other]), (3, [other]), (4, [other])):
        rows = [(d, BEGAN + hour * L.IDLE_MS + 20 * k, "gyr", 1.0, 1.0, 1.0) for d in here for k in range(2)] + [(other, BEGAN + hour * L.IDLE_MS + 60_000, "acc", 0.0, 0.0, 0.0)]
        part = spark.createDataFrame(rows, "device_id long, timestamp long, sensor string, x double, y double, z double")
        part.write.mode("append").parquet(f"{base}/in")
        start_available(L.stream_fuse(session.readStream.schema(part.schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint")
        states = session.read.format("statestore").option("stateVarName", "devices").load(f"{base}/checkpoint").select("user_map_value.states").collect()
        known = {d for r in states for d in L._table(bytes(r.states)).column("device").to_pylist()}
        assert known == ({other} if hour else {one, other})


def test_presets_table(spark):
    rows = {r["preset"]: r for r in D.presets(spark, spike=24.0, dip_required=False, still_seconds=0.1).collect()}
    assert rows["desk_safe"]["still_windows"] == 3 and rows["custom"]["freefall"] == 7.0 and rows["custom"]["still_windows"] == 1
