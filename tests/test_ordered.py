"""Sliced operators against one-piece brute force, with slices far smaller than a key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaitframe.operators.cleaning import decimate, interpolate
from gaitframe.operators.ordered import add_segments, carry_forward, exact_quantiles, ordered_position, time_slice


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    rows = []
    for key, n in (("hot", 900), ("cold", 40), ("one", 1)):
        ts = np.cumsum(rng.choice([20, 40, 500, 501, 900], n, p=[0.8, 0.1, 0.04, 0.03, 0.03])) + 1_600_000_000_000
        for t in ts:
            rows.append((key, int(t), float(rng.normal()) if rng.random() > 0.3 else None))
    return pd.DataFrame(rows, columns=["recording_id", "timestamp", "v"]).astype({"v": object}).where(lambda d: d.notna(), None)


@pytest.fixture(scope="module")
def df(spark, frame):
    schema = "recording_id string, timestamp long, v double"
    return spark.createDataFrame([tuple(r) for r in frame.itertuples(index=False)], schema).repartition(5)


def result(df, *cols):
    return df.select("recording_id", "timestamp", *cols).toPandas().sort_values(["recording_id", "timestamp"]).reset_index(drop=True)


def test_positions_in_slices(df, frame):
    got = result(ordered_position(df, ["recording_id"], ["timestamp"], time_slice(slice_ms=700)), "pos")
    want = frame.sort_values(["recording_id", "timestamp"]).groupby("recording_id").cumcount().to_numpy()
    assert (got["pos"].to_numpy() == want).all()


def test_global_position(df, frame):
    rows = ordered_position(df, [], ["timestamp", "recording_id"], time_slice(slice_ms=700)).toPandas()
    assert sorted(rows["pos"]) == list(range(len(frame)))
    assert rows.sort_values("pos")["timestamp"].is_monotonic_increasing


@pytest.mark.parametrize("slice_ms", [130, 700, 5_000, None])
def test_segments_do_not_depend_on_slices(df, frame, slice_ms):
    got = result(add_segments(df, slice_ms=slice_ms), "segment", "pos")
    want = frame.sort_values(["recording_id", "timestamp"]).reset_index(drop=True)
    cut = want.groupby("recording_id")["timestamp"].diff() > 500
    want["segment"] = cut.groupby(want["recording_id"]).cumsum()
    want["pos"] = want.groupby(["recording_id", "segment"]).cumcount()
    assert (got["segment"] == want["segment"]).all() and (got["pos"] == want["pos"]).all()
    assert want["segment"].max() > 20


@pytest.mark.parametrize("descending", [False, True])
def test_carry_in_slices(df, frame, descending):
    got = result(carry_forward(df, ["recording_id"], ["timestamp"], {"seen": F.col("v")}, time_slice(slice_ms=130), descending), "seen")
    want = frame.sort_values(["recording_id", "timestamp"]).reset_index(drop=True)
    filled = want.groupby("recording_id")["v"].transform(lambda s: (s.astype(float).bfill() if descending else s.astype(float).ffill()))
    np.testing.assert_array_equal(got["seen"].to_numpy(float), filled.to_numpy(float))


def test_interpolation_matches_pandas(df, frame):
    got = result(interpolate(df, 3, ["v"], slice_ms=700), "v")
    want = frame.sort_values(["recording_id", "timestamp"]).reset_index(drop=True)
    filled = want.groupby("recording_id")["v"].transform(
        lambda s: s.astype(float).interpolate(method="linear", limit=3, limit_direction="both"))
    np.testing.assert_allclose(got["v"].to_numpy(float), filled.to_numpy(float), atol=1e-12)


def test_decimation_keeps_first_of_every_run(df, frame):
    kept = decimate(df, 4, slice_by=time_slice(slice_ms=130)).groupBy("recording_id").count().collect()
    assert {r[0]: r[1] for r in kept} == {"hot": 225, "cold": 10, "one": 1}


def test_exact_quantiles_match_numpy(df, frame):
    got = exact_quantiles(df, ["recording_id"], "v", {"q05": 0.05, "q50": 0.5, "q99": 0.99}).toPandas().set_index("recording_id")
    for key, part in frame.groupby("recording_id"):
        values = part["v"].dropna().astype(float)
        if len(values):
            np.testing.assert_allclose(got.loc[key, ["q05", "q50", "q99"]].to_numpy(float), np.quantile(values, [0.05, 0.5, 0.99]))


def test_suppliers_are_ordered_in_several_slices(spark):
    """The one plan of the sensor view cuts suppliers at the checked size already."""
    from gaitframe.plans import sensor
    lines = sensor.table(spark, "/root/testdata/sf0.01", "lineitem")
    slices = lines.groupBy("l_suppkey").agg(F.countDistinct(F.floor(F.col("l_orderkey") / sensor.ORDER_KEYS_PER_SLICE)).alias("n"))
    assert slices.agg(F.min("n")).first()[0] >= 2


def test_quantiles_of_a_million_values_close_together(spark):
    """All values lie inside one bucket of the first histogram; no window orders more than a few of them."""
    values = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.xxhash64("id") / float(2**72) + 1.001).alias("v"))
    got = exact_quantiles(values, ["k"], "v", {"low": 0.25, "mid": 0.5, "top": 0.999}).first()
    want = np.quantile([r.v for r in values.select("v").collect()], [0.25, 0.5, 0.999])
    np.testing.assert_allclose([got.low, got.mid, got.top], want, rtol=0, atol=1e-15)
