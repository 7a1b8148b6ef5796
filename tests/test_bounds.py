"""Bounds that hold whatever the size of the input."""

import numpy as np
import pyarrow as pa

from gaitframe.functions import spectrum as SP
from gaitframe.operators import features as FE
from gaitframe.operators import windows as W
from gaitframe.schema import SENSORS


def channels(n, size=20):
    rng = np.random.default_rng(5)
    return [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * size, rng.normal(size=n * size)) for _ in SENSORS]


def test_features_of_a_large_batch_are_made_in_blocks(monkeypatch):
    n, seen, plain = 3 * FE.BLOCK + 7, [], FE.window_features
    held = channels(n)
    whole = plain(np.stack([c.flatten().to_numpy().reshape(n, -1) for c in held], axis=1))
    monkeypatch.setattr(FE, "window_features", lambda x: seen.append(len(x)) or plain(x))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *held], ["k", *SENSORS])
    out = pa.Table.from_batches(FE._feature_columns(1)(iter([batch])))
    assert max(seen) <= FE.BLOCK and sum(seen) == n and out.column("k").to_pylist() == list(range(n))
    got = np.stack([out.column(c).to_numpy() for c in FE.feature_names()], axis=1)
    assert np.array_equal(got, whole, equal_nan=True)


def test_spectrum_of_a_large_batch_is_made_in_blocks(monkeypatch):
    n, seen, plain = 3 * SP.BLOCK + 7, [], SP.spectrum
    held = channels(n)
    whole = plain(np.stack([c.flatten().to_numpy().reshape(n, -1) for c in held], axis=1)).reshape(n, -1)
    monkeypatch.setattr(SP, "spectrum", lambda x: seen.append(len(x)) or plain(x))
    out = list(SP.spectrum_udf.func(iter([tuple(held), tuple(c.slice(0, 0) for c in held)])))
    assert max(seen) <= SP.BLOCK and [len(o) for o in out] == [n, 0]
    assert np.array_equal(np.array(out[0].to_pylist()), whole)


def test_ticks_are_hashed_not_sorted(spark):
    """Sorting holds a row for every sample of every tick, hashing one for every tick."""
    rows = spark.createDataFrame([("r", i * 20, *[float(i % 7 + j) for j in range(6)]) for i in range(160)],
                                 "recording_id string, timestamp long, " + ", ".join(f"{c} double" for c in SENSORS))
    ticks = W.inference_ticks(rows, 400, extra=FE.device_metrics(), slice_ms=None)
    plan = ticks._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = {r.tick: tuple(r.last_sample) for r in ticks.collect()}
    assert got == {k: (float((20 * k + 99) % 7 + 1), float((20 * k + 99) % 7 + 2)) for k in range(4)}
