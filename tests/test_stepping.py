"""Walks over slices against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.operators import stepping as S

SCHEMA = "recording_id string, timestamp long, ax double, ay double, az double, gx double, gy double, gz double, low boolean"


def plain_ticks(rows, every=20, low=40, still=50, after=2, size=100):
    rows = sorted(rows, key=lambda r: r[1])
    out, p, run = [], size - 1, 0
    while p < len(rows):
        window = rows[p - size + 1:p + 1][::2]
        acc = [np.sqrt(r[2] ** 2 + r[3] ** 2 + r[4] ** 2) for r in window]
        calm = bool(np.var(acc) < 0.05 and max(abs(r[5]) + abs(r[6]) + abs(r[7]) for r in window) < 0.25)
        run = min(run + 1, after + 1) if calm else 0
        step = still if run > after else low if rows[p][8] else every
        out.append((p, rows[p][1], calm, run, step * 20))
        p += step
    return out


def recording(name, n, rng):
    rows, quiet, low = [], False, False
    for i in range(n):
        if rng.random() < 0.004:
            quiet = not quiet
        if rng.random() < 0.01:
            low = not low
        size = 0.01 if quiet else 2.0
        rows.append((name, 1_600_000_000_000 + i * 20 + (i // 700) * 5000, *(float(x) for x in rng.normal(size=2) * size), float(9.8 + rng.normal() * size),
                     *(float(x) for x in rng.normal(size=3) * size), low))
    return rows


@pytest.mark.parametrize("slice_ticks", [7, 64, 4096])
def test_adaptive_ticks(spark, slice_ticks):
    rng = np.random.default_rng(4)
    groups = {f"r{k}": recording(f"r{k}", n, rng) for k, n in enumerate((6000, 2500, 100, 99, 0, 101))} | {None: recording(None, 700, rng)}
    df = spark.createDataFrame([r for g in groups.values() for r in g], SCHEMA).withColumn("pos", F.lit(-1)).drop("pos")
    got = {}
    for r in S.adaptive_ticks(df, low_power=F.col("low"), slice_ms=20_000, slice_ticks=slice_ticks).collect():
        got.setdefault(r.recording_id, []).append(tuple(r)[1:])
    want = {k: t for k, g in groups.items() if (t := plain_ticks(g))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert {t[4] for v in want.values() for t in v} == {400, 800, 1000}


def test_adaptive_ticks_of_nothing(spark):
    assert S.adaptive_ticks(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        S.adaptive_ticks(spark.createDataFrame([], SCHEMA), every_ms=410)


@pytest.mark.parametrize("gap", [None, 0])
def test_entry_states_equal_a_fold(spark, gap):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key in ("a", "b", None):
        numbers = sorted(rng.choice(5000, 700, replace=False).tolist()) if key else [3]
        state, last = 2, numbers[0] - 1
        for n in numbers:
            state = state if gap is None or n == last + 1 else gap
            want[key, n] = state
            table = rng.integers(0, 5, 5).tolist()
            rows.append((key, n, table))
            state, last = table[state], n
    maps = spark.createDataFrame(rows, "k string, n long, t array<int>").repartition(5)
    got = {(r.k, r.n): r.entry for r in S.entry_states(maps, ["k"], "n", "t", 5, start=2, gap=gap).collect()}
    assert got == want
