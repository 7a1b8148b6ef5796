"""Window edges, window labels, and all features against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.operators import audits as Q
from gaitframe.operators import features as FE
from gaitframe.operators import joins as J
from gaitframe.operators import windows as W
from gaitframe.schema import SENSORS

SCHEMA = "recording_id string, subject_id string, dataset_id string, timestamp long, " + ", ".join(f"{c} double" for c in SENSORS) + ", label string"


def recording(name, n, label=lambda i: "walking", start=0, value=None, seed=1):
    rng = np.random.default_rng(seed)
    return [(name, "s1", "own", 1_600_000_000_000 + start + 20 * i, *map(float, rng.normal(size=6) if value is None else value(i)), label(i)) for i in range(n)]


def frame(spark, *parts):
    rows = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for p in parts for r in p]
    return W.segmented(spark.createDataFrame(rows, SCHEMA))


def test_window_counts_at_segment_edges(spark):
    parts = [recording(f"r{n}", n) for n in (99, 100, 149, 150)]
    got = {r[0]: r[1] for r in W.sample_windows(frame(spark, *parts)).groupBy("recording_id").count().collect()}
    assert got == {"r100": 1, "r149": 1, "r150": 2}


def test_windows_stay_inside_segments(spark):
    # a pause of exactly 500 ms joins, a longer one cuts
    joined = recording("a", 60) + recording("a", 60, start=59 * 20 + 500)
    cut = recording("b", 60) + recording("b", 60, start=59 * 20 + 501)
    got = {r[0]: r[1] for r in W.sample_windows(frame(spark, joined, cut)).groupBy("recording_id").count().collect()}
    assert got == {"a": 1}


def test_labels(spark):
    tie = recording("tie", 100, lambda i: "walking" if i < 50 else "running")
    mixed = recording("mixed", 100, lambda i: "walking" if i < 60 else "running")
    fall = recording("fall", 100, lambda i: "falling" if i == 7 else ("walking" if i % 2 else "lying"))
    seg = frame(spark, tie, mixed, fall)
    light = {r["recording_id"]: r["label"] for r in W.label_windows(seg).collect()}
    full = {r["recording_id"]: r["label"] for r in W.collect_windows(seg).collect()}
    assert light == full == {"mixed": "walking", "fall": "falling"}
    loose = {r["recording_id"]: r["label"] for r in W.label_windows(seg, min_purity=0.5).collect()}
    assert loose["tie"] == "running"  # smallest label wins a tie


def numpy_features(w):
    def moments(s):
        d = s - s.mean()
        return d, (d**2).mean()

    out = []
    for s in w.T:
        d, m2 = moments(s)
        out += [s.mean(), s.std(), s.min(), s.max(), np.ptp(s), np.sqrt((s**2).mean()), np.ptp(s), np.mean(np.diff(np.sign(d)) != 0),
                np.abs(d).mean(), (d**3).mean() / m2**1.5, (d**4).mean() / m2**2 - 3, np.subtract(*np.percentile(s, [75, 25]))]
    out += [np.abs(w[:, :3]).sum(1).mean(), np.abs(w[:, 3:]).sum(1).mean()]
    out += [np.corrcoef(w[:, i], w[:, j])[0, 1] for i, j in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5))]
    f = np.fft.rfftfreq(100, 0.02)
    for s in w.T:
        p = np.abs(np.fft.rfft(s - s.mean())) ** 2
        q, top = p / (p.sum() + 1e-12), p[1:].argmax() + 1
        out += [f[top], q[top], -(q * np.log(q + 1e-12)).sum() / np.log(51), (f * q).sum(), q[f < 2].sum(),
                q[(f >= 2) & (f < 5)].sum(), q[(f >= 5) & (f < 25)].sum()]
    acc, gyr = np.linalg.norm(w[:, :3], axis=1), np.linalg.norm(w[:, 3:], axis=1)
    for m in (acc, gyr):
        out += [m.mean(), m.std(), m.max()]
    for m in (acc, gyr):
        out += [np.abs(np.diff(m)).mean(), np.abs(np.diff(m)).max()]
    total = np.linalg.norm(w, axis=1)
    return np.array(out + [total.mean(), total.max()])


def test_all_134_features_match_numpy(spark):
    windows = W.collect_windows(frame(spark, recording("r", 250)))
    names = FE.feature_names()
    assert len(names) == len(set(names)) == 134
    raw = {r["k"]: np.array([[s[c] for c in SENSORS] for s in r["samples"]]) for r in windows.collect()}
    rows = FE.extract_features(windows).collect()
    assert len(rows) == 4
    for r in rows:
        np.testing.assert_allclose([r[n] for n in names], numpy_features(raw[r["k"]]), rtol=1e-9, atol=1e-9)


def test_constant_channels_have_no_shape(spark):
    still = recording("r", 100, value=lambda i: (0.1, 0.2 + i, 9.8, 0.0, 0.0, 0.0))
    row = FE.extract_features(W.collect_windows(frame(spark, still))).first()
    assert row["ax_skew"] is None and row["gx_kurt"] is None and row["corr_ax_ay"] is None
    assert row["gx_dom_freq"] == 0.5 and row["gx_dom_energy"] == 0.0 and row["ay_kurt"] is not None


def test_empty_input_gives_empty_windows(spark):
    windows = W.collect_windows(frame(spark, recording("r", 30)))
    assert FE.extract_features(windows).count() == 0


def test_latest_and_peak(spark):
    loud = recording("r", 400, value=lambda i: (50.0 if i == 100 else 0.0, 0, 9.8, 0, 0, 0))
    df = frame(spark, loud, recording("short", 20))
    last = W.latest_n(df, 100).select("recording_id", "at", "timestamp").orderBy("at").collect()
    assert len(last) == 100 and last[0]["at"] == 0 and last[-1]["timestamp"] == 1_600_000_000_000 + 399 * 20
    peaks = {r["k"]: (r["label"], r["peak_pos"]) for r in W.peak_windows(df).collect()}
    # centre of window k is 50 k + 50: within 50 of 100 for k = 0 to 2, beyond 200 from k = 4 on
    assert {k: v[0] for k, v in peaks.items()} == {0: "falling", 1: "falling", 2: "falling", 4: "lying", 5: "lying", 6: "lying"}
    assert {v[1] for v in peaks.values()} == {100}


def test_near_duplicates_against_brute_force(spark):
    train = W.collect_windows(frame(spark, *[recording(f"a{i}", 150, seed=i) for i in range(6)]))
    test = W.collect_windows(frame(spark, recording("b", 150, seed=3), recording("c", 150, seed=99)))

    def vectors(df):
        return {(r["recording_id"], r["k"]): np.array([[s[c] for s in r["samples"]] for c in SENSORS]).ravel() for r in df.collect()}

    a, b = vectors(train), vectors(test)
    unit = lambda v: v / np.linalg.norm(v)
    got = {(r["recording_id"], r["k"]): (r["min_distance"], r["near_duplicate"]) for r in J.near_duplicates(train, test).collect()}
    assert set(got) == set(b)
    for key, (distance, near) in got.items():
        want = min(1 - unit(b[key]) @ unit(v) for v in a.values())
        assert abs(distance - want) < 1e-6 and near == (want < 0.01)
    assert J.exact_duplicates(train, test).count() == 2  # both windows of b are windows of a3
    assert Q.duplicate_audit(train, test).first()["exact_duplicates"] == 2


def test_speed_change_is_linear_resampling(spark):
    ramp = recording("r", 150, value=lambda i: (float(i), 0, 0, 0, 0, 0))
    rows = W.explode_windows(Q.speed_windows(W.collect_windows(frame(spark, ramp)))).select("k", "at", "ax").collect()
    for r in rows:
        start = 50 * r["k"]
        assert abs(r["ax"] - (start + min(r["at"] * (1.3 if r["k"] % 2 == 0 else 0.7), 99))) < 1e-9


def test_windows_of_sliced_and_whole_recordings_agree(spark):
    from gaitframe.operators.ordered import add_segments
    rows = spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in recording("r", 700)], SCHEMA)
    key = F.concat_ws(":", "segment", "k", "start_ts")
    whole, sliced = (sorted(r[0] for r in W.sample_windows(add_segments(rows, slice_ms=s)).select(key).collect()) for s in (None, 1_000))
    assert whole == sliced and len(whole) == 13


@pytest.mark.parametrize("p,want", [([1.0, 1.0], [0.5, 0.5]), ([1000.0, 0.0], [1.0, 0.0])])
def test_softmax_is_stable(spark, p, want):
    from gaitframe.functions.columns import softmax
    got = spark.createDataFrame([(p,)], "x array<double>").select(softmax("x")).first()[0]
    np.testing.assert_allclose(got, want)


def test_features_do_not_depend_on_the_memory_layout():
    x = np.random.default_rng(2).normal(size=(40, 6, 100))
    for axes in ((1, 2, 0), (2, 0, 1), (2, 1, 0), (1, 0, 2), (0, 2, 1)):
        other = np.ascontiguousarray(x.transpose(axes)).transpose(np.argsort(axes))
        np.testing.assert_array_equal(FE.window_features(other), FE.window_features(x))


def test_changed_samples_are_worked_out_once_per_window(spark):
    """No filter on the number of samples is moved below the window's label, where the label would be made per sample."""
    windows = W.collect_windows(frame(spark, recording("a", 150), recording("f", 100, lambda i: "falling")))
    rows = W.explode_windows(Q.slump_windows(windows))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "0.55" in line]
    assert {r["recording_id"]: r["count"] for r in rows.groupBy("recording_id").count().collect()} == {"a": 200, "f": 100}
    empty = windows.withColumn("samples", F.when(F.col("recording_id") == "a", F.slice("samples", 1, 0)))
    assert W.explode_windows(empty).count() == 0
