"""Readers on hand-written files, sinks, and alert records."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators import alerts as L
from gaitframe.operators import cleaning as K
from gaitframe.operators import registry as G
from gaitframe.sources import lines as T
from gaitframe.sources import recordings as R
from gaitframe.sources import sinks as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_sessions_with_different_headers(spark, tmp_path):
    write(tmp_path / "s01_morning.csv", "Timestamp, AX,ay,az,gx,gy,gz,Label\n0,1,2,9,0,0,0, Walking \n20,2,2,9,0,0,0,jumping\n40,99,2,9,0,0,0,walking\n60,x,2,9,0,0,0,walking\n600,3,2,9,0,0,0,FALLING\n")
    write(tmp_path / "s02_a.csv", "label,gz,gy,gx,az,ay,ax,timestamp\nlying,3,2,1,9,5,4,100\n\nlying,3,2,1,9,5,4,120,surplus\n")
    write(tmp_path / "bad_file.csv", "timestamp,ax,ay,az,gx,gy,label\n0,1,2,3,4,5,walking\n")
    rows = R.read_sessions(spark, str(tmp_path)).orderBy("subject_id", "timestamp").collect()
    assert [(r["subject_id"], r["timestamp"], r["ax"], r["label"], r["segment"], r["pos"]) for r in rows] == [
        ("s01", 0, 1.0, "walking", 0, 0), ("s01", 600, 3.0, "falling", 1, 0), ("s02", 100, 4.0, "lying", 0, 0)]
    assert (rows[2]["gx"], rows[2]["gz"]) == (1.0, 3.0)
    bad = {os.path.basename(r["file_path"]): (r["reason"], r["n_lines"]) for r in
           T.quarantine(T.with_header(T.read_lines(spark, str(tmp_path)), R.SESSION_COLUMNS)).collect()}
    assert bad == {"bad_file.csv": ("missing columns: gz", 1), "s02_a.csv": ("malformed lines", 1)}


def test_line_order_survives_many_splits(spark, tmp_path):
    n = 4000
    write(tmp_path / "SisFall" / "SE07" / "D01_SE07_R03.txt", "".join(f"{i},{-i},256,10,20,30,1,1,1;\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert T.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        rows = R.read_sisfall(spark, str(tmp_path)).orderBy("timestamp").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    scale = 32 / 8192 * 9.80665
    assert len(rows) == n // 4 and [round(r["ax"] / scale) for r in rows] == list(range(0, n, 4))
    assert [r["timestamp"] for r in rows[:3]] == [1_600_000_000_000, 1_600_000_000_020, 1_600_000_000_040]
    first = rows[0]
    assert (first["subject_id"], first["recording_id"], first["unified_label"]) == ("sisfall_young07", "sisfall_young07_D01_r03", "walking")
    assert math.isclose(first["gy"], 20 * (4000 / 65536) * math.pi / 180)


def test_sisfall_cap_and_short_lines(spark, tmp_path):
    for code in ("D01", "D02", "F01"):
        write(tmp_path / "SisFall_dataset" / "SA01" / f"{code}_SA01_R01.txt", "1,2,3,4,5,6;\n1,2,3;\n")
    assert R.read_sisfall(spark, str(tmp_path)).count() == 3
    kept = R.read_sisfall(spark, str(tmp_path), max_recordings=2).select("original_label", "subject_id").collect()
    assert sorted(r[0] for r in kept) == ["D01", "D02"] and kept[0][1] == "sisfall_older01"


def test_mobiact_folders(spark, tmp_path):
    body = "".join(f"{i * 5},{i},0,9,180,0,0\n" for i in range(8))
    write(tmp_path / "MobiAct" / "WAL" / "WAL_001_2.csv", "timestamp,acc_x,acc_y,acc_z,gyro_x,gyro_y,gyro_z\n# note\n" + body)
    write(tmp_path / "MobiAct" / "FOL" / "FOL_12_1.csv", "AX,AY,AZ,GX,GY,GZ\n" + "1,2,3,4,5,6\n" * 5)
    write(tmp_path / "MobiAct" / "ZZZ" / "ZZZ_1_1.csv", "ax,ay,az,gx,gy,gz\n1,2,3,4,5,6\n")
    rows = R.read_mobiact(spark, str(tmp_path)).orderBy("recording_id", "timestamp").collect()
    assert [(r["recording_id"], r["timestamp"], r["ax"], r["unified_label"]) for r in rows] == [
        ("mobiact_001_WAL_2", 0, 0.0, "walking"), ("mobiact_001_WAL_2", 20, 4.0, "walking"),
        ("mobiact_012_FOL_1", 1_600_000_000_000, 1.0, "falling"), ("mobiact_012_FOL_1", 1_600_000_000_020, 1.0, "falling")]
    assert math.isclose(rows[0]["gx"], math.pi)
    means = R.mobiact_rows(T.read_lines(spark, f"{tmp_path}/MobiAct/WAL"), average=True).orderBy("timestamp").collect()
    assert [r["ax"] for r in means] == [1.5, 5.5]


def test_kfall_positions_and_own_names(spark, tmp_path):
    text = "SampleTimeFine,acc_x,acc_y,acc_z,gyr_x,gyr_y,gyr_z\n" + "".join(f"7,{i},0,9,1,1,1\n" for i in range(5))
    write(tmp_path / "KFall" / "KFall_dataset" / "S01" / "S01_FALL02_T01_Wrist.csv", text)
    rows = R.read_kfall(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [r["ax"] for r in rows] == [0.0, 2.0, 4.0] and rows[1]["timestamp"] == 1_600_000_000_020
    assert (rows[0]["recording_id"], rows[0]["phone_position"], rows[0]["unified_label"]) == ("kfall_01_FALL02_T01_Wrist", "wrist", "falling")
    write(tmp_path / "own" / "ann_s02_pocket_up.csv", "timestamp,ax,ay,az,gx,gy,gz,label\n1,1,1,1,,,,Jog\n2,1,1,1,,,,dance\n")
    own = R.read_own(spark, str(tmp_path / "own")).orderBy("timestamp").collect()
    assert [(r["subject_id"], r["recording_id"], r["phone_position"], r["unified_label"], r["gx"]) for r in own] == [
        ("own_ann", "own_ann_s02", "pocket", "running", None), ("own_ann", "own_ann_s02", "pocket", "unknown", None)]


def test_unimib_windows(spark):
    flat = [float(i) for i in range(453)]
    windows = spark.createDataFrame([("fall", 3, flat, 1, 7), ("fall", 4, flat, 9, 7)], "kind string, w int, values array<double>, class_index int, subject int")
    names = spark.createDataFrame([("fall", 1, "BSC")], "kind string, class_index int, name string")
    rows = R.unimib_rows(windows, names).orderBy("recording_id", "timestamp").collect()
    assert len(rows) == 302 and (rows[1]["ax"], rows[1]["az"], rows[1]["gx"]) == (3.0, 5.0, None)
    assert rows[0]["recording_id"] == "unimib_07_fall_0003" and rows[0]["unified_label"] == "falling" and rows[200]["unified_label"] == "unknown"
    assert rows[0]["timestamp"] == 1_600_000_000_000 + 3 * 453 * 20


def test_harmonize_lists_what_is_missing(spark, tmp_path):
    write(tmp_path / "own" / "ann_s1.csv", "timestamp,ax,ay,az,gx,gy,gz,label\n1,1,1,1,,,,walk\n2,,1,1,1,1,1,walk\n3,1,1,1,1,1,1,dance\nx,1,1,1,1,1,1,walk\n")
    merged, skipped = R.harmonize({"own": lambda: R.read_own(spark, str(tmp_path / "own")), "kfall": lambda: R.read_kfall(spark, str(tmp_path))})
    rows = merged.collect()
    assert list(skipped) == ["kfall"] and len(rows) == 1 and rows[0]["has_gyro"] is False and rows[0]["gx"] == 0.0
    assert rows[0]["age_group"] == "unknown"
    with pytest.raises(RuntimeError):
        R.harmonize({"kfall": lambda: R.read_kfall(spark, str(tmp_path))})


def test_cache_is_written_once_and_invalidated(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, x int")
    calls = []
    path = str(tmp_path / "cache")

    def build():
        calls.append(1)
        return df

    assert S.cached(spark, path, build).count() == 2 and S.cached(spark, path, build).count() == 2 and len(calls) == 1
    S.invalidate(df, path)
    assert S.cached(spark, path, build).count() == 2 and len(calls) == 2


def test_archive_round_trip(spark, tmp_path):
    sample = ", ".join(f"named_struct('at', {i}, 'timestamp', {i * 20}L, 'ax', {i}D, 'ay', 0D, 'az', 9D, 'gx', 0D, 'gy', 0D, 'gz', 0D, 'label', 'falling')" for i in range(3))
    windows = spark.sql(f"SELECT 'r' AS recording_id, 'falling' AS label, array({sample}) AS samples, 1000L AS confirmed_at, 31.5D AS impact_peak, true AS confirmed")
    path = str(tmp_path / "archive")
    S.write_archives(S.archive_rows(windows), path)
    rows = R.read_archives(spark, path).collect()
    assert [(r["timestamp"], r["ax"], r["label"], r["impact_peak"]) for r in rows] == [(940, 0.0, "falling", 31.5), (960, 1.0, "falling", 31.5), (980, 2.0, "falling", 31.5)]
    assert S.write_session_csv(spark.createDataFrame([], "timestamp long, label string"), str(tmp_path / "none")) is False


def test_split_manifest_is_frozen(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", "d") for i in range(10)], "subject_id string, dataset_id string")
    path = str(tmp_path / "split")
    first = {r[0]: r[2] for r in S.frozen_split(rows, path, seed=1).collect()}
    assert {r[0]: r[2] for r in S.frozen_split(rows, path, seed=2).collect()} == first
    assert {r[0]: r[2] for r in S.frozen_split(rows, path, force=True, seed=2).collect()} != first
    with pytest.raises(AnalysisException):
        S.save_split(S.load_split(spark, path), path)
    write(tmp_path / "object.json", json.dumps({"train": ["a", "b"], "validation": [], "test": ["c"]}, indent=2))
    assert sorted(map(tuple, S.read_split_object(spark, str(tmp_path / "object.json")).collect())) == [("a", "train"), ("b", "train"), ("c", "test")]


def test_alert_defaults_and_contacts(spark):
    doc = json.dumps([{"id": "1", "timestamp": 5, "outcome": "NONSENSE", "latitude": 1.5}, {"outcome": "CANCELLED_EARLY"}])
    rows = L.parse_alerts(spark.createDataFrame([("d", doc)], "device_id string, alerts_json string"), now_ms=F.lit(77)).collect()
    assert (rows[0]["outcome"], rows[0]["activityBeforeFall"], rows[0]["longitude"]) == ("DISMISSED_SAFE", "walking", None)
    assert rows[1]["outcome"] == "CANCELLED_EARLY" and rows[1]["timestamp"] == 77 and rows[1]["id"]
    people = json.dumps([{"id": "1", "name": " ", "phone": "1"}, {"id": "2", "name": " Bo ", "phone": " 12-3 4 "}, {"id": "3", "name": "Cy", "phone": "--"},
                         {"id": "4", "name": "Di", "phone": "9"}])
    got = L.parse_contacts(spark.createDataFrame([("d", people)], "device_id string, contacts_json string")).orderBy("position").collect()
    assert [(r["position"], r["name"], r["phone"]) for r in got] == [(0, "Bo", "1234"), (1, "Di", "9")]


def test_text_and_age_rules(spark):
    def value(expr):
        return spark.range(1).select(expr).first()[0]

    now = 10 * 86_400_000
    ages = [value(C.relative_age(F.lit(now - d), F.lit(now))) for d in (59_000, 60_000, 3_599_000, 3_600_000, 86_399_000, 86_400_000, 172_800_000)]
    assert ages == ["Just now", "1 min ago", "59 min ago", "1 hr ago", "23 hr ago", "Yesterday", "2 days ago"]
    groups = {s: value(C.age_group(F.lit(s))) for s in ("sisfall_older03", "sisfall_young01", "own_user01", "mobiact_001", "SE05")}
    assert groups == {"sisfall_older03": "older_adult", "sisfall_young01": "young_adult", "own_user01": "unknown", "mobiact_001": "adult", "SE05": "young_adult"}
    assert "Location unavailable" in value(C.sos_body(F.lit(0), F.lit(None).cast("double"), F.lit(1.0)))


def test_registry(spark):
    assert G.label_mapping(spark).count() == 18 + 16 + 34 + 16 and len(G.LABEL_ALIASES) == 25 and G.registry(spark).count() == 4
    with pytest.raises(KeyError):
        G.get_dataset(spark, "nowhere")
    assert G.get_dataset(spark, "kfall").first()["sampling_rate_hz"] == 100


def test_bounds_let_missing_values_pass(spark):
    df = spark.createDataFrame([(1.0, None), (41.0, None), (None, 36.0), (40.0, 35.0)], "ax double, gx double")
    df = df.withColumns({c: F.lit(0.0) for c in ("ay", "az", "gy", "gz")})
    assert sorted(r["ax"] for r in K.drop_out_of_range(df).collect()) == [1.0, 40.0]


@pytest.mark.parametrize("slice_ms", [50, 170, 10**6])
def test_throttle_counts_from_the_last_emitted_row(spark, slice_ms):
    rng = np.random.default_rng(2)
    clocks = {"a": [0, 40, 80, 120, 160, 190, 210, 260, 310], "b": np.cumsum(rng.choice([1, 7, 60, 99, 100, 450], 400)).tolist(), "c": [5, 5, 5]}
    df = spark.createDataFrame([(k, int(t), i) for k, v in clocks.items() for i, t in enumerate(v)], "recording_id string, timestamp long, n int")
    got = {}
    for r in L.throttle(df, slice_ms=slice_ms).orderBy("timestamp").collect():
        got.setdefault(r.recording_id, []).append(r.timestamp)
    for k, v in clocks.items():
        want, last = [], None
        for t in v:
            if last is None or t - last >= 100:
                want.append(t)
                last = t
        assert got[k] == want
    assert got["a"] == [0, 120, 260] and L.throttle(df.limit(0)).count() == 0


def test_unreadable_file_is_skipped_and_listed(spark, tmp_path):
    import gzip
    write(tmp_path / "in" / "good_1.csv", "a,b\n1,2\n3,4\n")
    (tmp_path / "in" / "bad_1.csv.gz").write_bytes(gzip.compress(b"a,b\n" * 5)[:-12] + b"rubbish rubbish")
    (tmp_path / "in" / "worse_1.csv.gz").write_bytes(b"not compressed at all")
    (tmp_path / "in" / "empty_1.csv").write_bytes(b"")
    lines = T.read_lines(spark, str(tmp_path / "in"))
    assert [r.value for r in lines.filter(lines.file_path.contains("good")).orderBy("line_id").collect()] == ["a,b", "1,2", "3,4"]
    lost = T.unread_files(spark, str(tmp_path / "in"), lines).collect()
    assert "worse_1.csv.gz" in {r.file_path.rpartition("/")[2] for r in lost} and not {"good_1.csv", "empty_1.csv"} & {r.file_path.rpartition("/")[2] for r in lost}


def test_file_with_a_broken_tail_is_skipped_whole_and_listed(spark, tmp_path):
    import gzip
    import random
    rng, head = random.Random(1), "timestamp,ax,ay,az,gx,gy,gz,label\n"
    body = head + "".join(f"{20 * i},{rng.random()},1,9,0,0,0,walking\n" for i in range(60_000))
    (tmp_path / "s01_cut.csv.gz").write_bytes(gzip.compress(body.encode())[:-2000])
    (tmp_path / "s02_whole.csv.gz").write_bytes(gzip.compress(f"{head}0,1,2,9,0,0,0,walking\n".encode()))
    write(tmp_path / "s03_plain.csv", f"{head}0,1,2,9,0,0,0,walking\n")
    with pytest.warns(T.UnreadableFile, match="s01_cut"):
        lines = T.read_lines(spark, str(tmp_path))
    assert {(r.file_path.rpartition("/")[2], r.n) for r in lines.groupBy("file_path").agg(F.count("*").alias("n")).collect()} == {
        ("s02_whole.csv.gz", 2), ("s03_plain.csv", 2)}
    assert [r.file_path.rpartition("/")[2] for r in T.unread_files(spark, str(tmp_path), lines).collect()] == ["s01_cut.csv.gz"]
    with pytest.warns(T.UnreadableFile):
        rows, skipped = R.harmonize({"own": lambda: R.own_rows(T.read_lines(spark, str(tmp_path)))})
    assert [k.rpartition("/")[2] for k in skipped] == ["s01_cut.csv.gz"] and rows.count() == 2
    with pytest.warns(T.UnreadableFile):
        assert T.read_lines(spark, str(tmp_path / "s01_cut.csv.gz")).count() == 0


def test_other_read_failures_are_raised(spark, tmp_path, monkeypatch):
    (tmp_path / "s01.csv.gz").write_bytes(b"not compressed at all")
    monkeypatch.setattr(T, "_DECODERS", ("at java.net.",))
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        T.read_lines(spark, str(tmp_path))


def test_named_files_are_written_in_order_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"kind {k % 3}/f{k}.txt", 0, i, None if i == 3 else f"line {i} é of {k}") for k in range(9) for i in rng.permutation(300 if k else 1).tolist()]
    lines = spark.createDataFrame(rows, "file_path string, block_start long, line_id long, value string").repartition(5)
    root = str(tmp_path / "named")
    got = {r.file_path: r.n_lines for r in S.write_text_files(lines, root).collect()}
    assert got == {f"kind {k % 3}/f{k}.txt": 300 if k else 1 for k in range(9)}
    for k in range(9):
        want = ["" if i == 3 else f"line {i} é of {k}" for i in range(300 if k else 1)]
        assert (tmp_path / "named" / f"kind {k % 3}" / f"f{k}.txt").read_text().split("\n")[:-1] == want
    assert S.write_text_files(lines, f"file://{root}").count() == 9
    assert len(list((tmp_path / "named").rglob("*"))) == 12
    assert S.write_text_files(lines.limit(0), str(tmp_path / "none")).count() == 0
    assert T.read_lines(spark, root).count() == 8 * 299 + 1


def test_unimib_folders(spark, tmp_path):
    spark.createDataFrame([("adl", 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1, 7), ("fall", 0, [9.0, 9.0, 9.0], 5, 8)],
                          "kind string, w int, values array<double>, class_index int, subject int").write.parquet(f"{tmp_path}/windows")
    spark.createDataFrame([("adl", 1, "WAL")], "kind string, class_index int, name string").write.parquet(f"{tmp_path}/names")
    got = {(r.recording_id, r.ax, r.az, r.unified_label) for r in R.read_unimib(spark, str(tmp_path)).collect()}
    assert got == {("unimib_07_adl_0002", 1.0, 3.0, "walking"), ("unimib_07_adl_0002", 4.0, 6.0, "walking"), ("unimib_08_fall_0000", 9.0, 9.0, "unknown")}


def test_a_lost_writer_leaves_the_cache_whole(spark, tmp_path):
    """A version without its pointer is not read, whether the writer was the first or a later one."""
    path, df = str(tmp_path / "cache"), spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, x int")
    half = df.withColumn("x", F.when(F.col("x") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    for build, want in ((half, None), (df, 2), (half, 2)):
        try:
            S.cache_write(build, path)
        except Exception as lost:
            assert "lost" in str(lost)
        found = S.cache_read(spark, path)
        assert (found and found.count()) == want
    df.write.partitionBy("dataset_id").parquet(f"{path}/v-unfinished")
    assert S.cache_read(spark, path).count() == 2
    S.cache_write(df.union(df), path)
    assert S.cache_read(spark, path).count() == 4 and S.published(spark, str(tmp_path / "none")) is None


def test_many_files_are_listed_by_few_tasks_and_not_opened(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a_1.csv").write_text("x\n")
    before = spark.conf.get(T._LISTERS)
    context = spark.sparkContext
    context.setJobGroup("many-files", "")
    lines = T.read_lines(spark, f"{tmp_path}/d*/*.csv")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many-files") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(s.numTasks for s in stages if s) <= 8 * context.defaultParallelism
    assert spark.conf.get(T._LISTERS) == before and lines.count() == 100


@pytest.mark.parametrize("block", [1, 3, 11, 1000])
def test_every_line_belongs_to_one_block(monkeypatch, block):
    import io
    import re
    from gaitframe.sources import files
    monkeypatch.setattr(files, "_READ", 5)
    rng = np.random.default_rng(block)
    for _ in range(200):
        data = "".join(rng.choice(["a", "b", "\n", "\r", "\r\n", "long line"], rng.integers(0, 40))).encode()
        want = re.split(rb"\r\n|\r|\n", data)
        got = [v for at in range(0, len(data), block) for lines in files.block_lines(io.BytesIO(data), at, min(at + block, len(data))) for v in lines]
        assert got == (want if want[-1] else want[:-1])


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Neither the listing nor the lines hold Spark's index of files, which lies on the driver; the same files are found."""
    from pyspark.errors import AnalysisException
    for name in ("S1/a_1.csv", "S1/.hidden.csv", "S1/_part.csv", "S2/b 2.csv", "T3/c.csv", "S4/deep/d.csv", "S4/x.txt"):
        write(tmp_path / name, "\ufeffx,y\r\n1,é\n\n2,3")
    for path in (f"{tmp_path}/S*/*.csv", f"file://{tmp_path}/S*/*.csv", f"{tmp_path}/S[12]/?*.csv", f"{tmp_path}/S*", str(tmp_path), f"{tmp_path}/S1/a_1.csv"):
        lines = T.read_lines(spark, path)
        known = spark.read.option("recursiveFileLookup", "true").text(path).selectExpr("url_decode(_metadata.file_path) AS file_path", "value").filter("value <> ''")
        assert sorted(map(tuple, lines.select("file_path", "value").collect())) == sorted(map(tuple, known.collect())) != []
        plan = lines._jdf.queryExecution().optimizedPlan().toString() + T.unread_files(spark, path, lines)._jdf.queryExecution().optimizedPlan().toString()
        assert " text" not in plan and "binaryFile" not in plan
    for path in (f"{tmp_path}/no", f"{tmp_path}/S*/*.dat"):
        with pytest.raises(AnalysisException):
            T.read_lines(spark, path)
    lines = spark.createDataFrame([("a/f.csv", 0, 2, "2", "head"), ("a/f.csv", 0, 1, "1", "head"), ("g.csv", 0, 1, "1", None)], "file_path string, block_start long, line_id long, value string, header string")
    assert sorted(map(tuple, S.write_text_files(lines, str(tmp_path / "headed")).collect())) == [("a/f.csv", 3), ("g.csv", 1)]
    assert (tmp_path / "headed" / "a" / "f.csv").read_text() == "head\n1\n2\n"
