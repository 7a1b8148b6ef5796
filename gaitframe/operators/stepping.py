"""Walks over ordered rows in which the row decides how far the next stop is.

Such a walk (a throttle, ticks of varying interval) can't be cut into independent pieces, but a slice of rows is a
function: it turns the state in which it is entered into the state in which it is left, and there are few states. Every
slice tabulates its function, tables are composed ``FAN`` at a time in logarithmically many rounds, the entry states
come back down the same tree, and every slice walks its own rows once more from its known entry. No task holds more
than a slice or ``FAN`` tables, however long a key is.

Cases. Null keys are a key of their own, as in a grouping. Missing slices leave the state as it is, or lead to ``gap``.
An empty table gives an empty one.
"""

from collections.abc import Sequence
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators.ordered import ordered_position, time_slice
from gaitframe.schema import SLICE_MS, WINDOW_SIZE
from gaitframe.session import materialize

BITS = 4
FAN = 1 << BITS
_ROWS = 64


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys of ``a`` stay."""
    return a.join(b, _same(a, b, keys), how).drop(*[b[k] for k in keys])


def _after(children: Column | str, entry: Column, gap: int | None, upto: Column | None, begin: Column) -> Column:
    """State after ``children`` (number ``s``, table ``t``), entered at ``begin`` and left at ``upto``."""

    def passed(state: Column, at: Column, to: Column) -> Column:
        return state if gap is None else F.when(to > at, F.lit(gap)).otherwise(state)

    walked = F.aggregate(
        children, F.struct(entry.cast("int").alias("x"), begin.cast("long").alias("n")),
        lambda a, c: F.struct(F.get(c["t"], passed(a["x"], a["n"], c["s"])).alias("x"), (c["s"] + 1).alias("n")))
    return passed(walked["x"], walked["n"], upto) if upto is not None else walked["x"]


def entry_states(maps: DataFrame, keys: Sequence[str], number: str, table: str, states: int, start: int = 0,
                 gap: int | None = None) -> DataFrame:
    """``keys, number, entry``: the state in which each slice is entered (runs jobs).

    ``maps`` has one row per key and slice with ``table``, the state after the slice for each of ``states`` before it. A
    key begins in ``start``. It is read twice, so it should be cheap or written.
    """
    keys = list(keys)
    bounds = maps.groupBy(*keys).agg(F.min(number).alias("_low"), F.max(number).alias("_high"))
    span = bounds.agg(F.max(F.col("_high") - F.col("_low"))).first()[0]
    if not span:
        return maps.select(*keys, number, F.lit(start).alias("entry"))
    based = join_on(maps.select(*keys, number, F.col(table).alias("t")), bounds.select(*keys, "_low"), keys)
    level, levels = based.select(*keys, (F.col(number) - F.col("_low")).cast("long").alias("s"), "t"), []
    while span:
        above = level.groupBy(*keys, F.shiftright("s", BITS).alias("p")).agg(F.array_sort(F.collect_list(F.struct("s", "t"))).alias("c"))
        levels.append(materialize(above, "slice-tables"))
        whole = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda x: _after("c", x, gap, (F.col("p") + 1) * FAN, F.col("p") * FAN))
        level, span = levels[-1].select(*keys, F.col("p").alias("s"), whole.alias("t")), span >> BITS
    entries = levels[-1].select(*keys, "p", F.lit(start).alias("entry"))

    def entered(c: Column, i: Column) -> Column:
        return F.struct(c["s"].alias("s"), _after(F.slice("c", F.lit(1), i), F.col("entry"), gap, c["s"], F.col("p") * FAN).alias("entry"))

    for above in reversed(levels):
        below = join_on(above, entries, [*keys, "p"]).select(*keys, F.explode(F.transform("c", entered)).alias("e"))
        entries = materialize(below.select(*keys, F.col("e.s").alias("p"), "e.entry"), "slice-entries")
    return join_on(entries, bounds.select(*keys, "_low"), keys).select(*keys, (F.col("p") + F.col("_low")).alias(number), "entry")


# -- ticks of varying interval ---------------------------------------------------------------------

def _padded(columns: Sequence[np.ndarray], kind: str) -> np.ndarray:
    out = np.zeros((len(columns), max(map(len, columns), default=0)), kind)
    for i, c in enumerate(columns):
        out[i, :len(c)] = c
    return out


def tick_tables(still: Sequence[np.ndarray], step: Sequence[np.ndarray], still_step: int, after: int, reach: int) -> np.ndarray:
    """Exit state of each slice for each entry state ``offset * (after + 1) + still ticks so far``."""
    size, calm, steps = np.array([len(s) for s in still]), _padded(still, "bool"), _padded(step, "int32")
    kinds, n = after + 1, calm.shape[1]
    over = np.maximum(np.arange(n + reach)[None, :] - size[:, None], 0)
    ends = over[:, :, None] * kinds + np.arange(kinds)
    rows = np.arange(len(size))
    for j in range(n - 1, -1, -1):
        inside, quiet = j < size, calm[:, j]
        found = []
        for c in range(kinds):
            jump = np.where(quiet & (c >= after), still_step, steps[:, j])
            found.append(ends[rows, j + jump, np.where(quiet, min(c + 1, after), 0)])
        ends[inside, j] = np.stack(found, axis=1)[inside]
    return ends[:, :reach].reshape(len(size), reach * kinds)


def tick_walk(still: Sequence[np.ndarray], step: Sequence[np.ndarray], entry: np.ndarray, still_step: int,
              after: int) -> list[list[tuple[int, int, int]]]:
    """(place, still ticks in a row, steps to the next) of the ticks of each slice."""
    size, calm, steps = np.array([len(s) for s in still]), _padded(still, "bool"), _padded(step, "int32")
    at, run, out = entry // (after + 1), entry % (after + 1), []
    for j in range(calm.shape[1]):
        here = np.flatnonzero((at == j) & (j < size))
        if len(here):
            run[here] = np.where(calm[here, j], np.minimum(run[here] + 1, after + 1), 0)
            jump = np.where(run[here] > after, still_step, steps[here, j])
            at[here] += jump
            out.append(np.stack([here, np.full(len(here), j), run[here], jump], axis=1))
            run[here] = np.minimum(run[here], after)
    ticks = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    ticks = ticks[np.lexsort((ticks[:, 1], ticks[:, 0]))]
    return [ticks[a:b, 1:].tolist() for a, b in zip(np.searchsorted(ticks[:, 0], np.arange(len(size))), np.searchsorted(ticks[:, 0], np.arange(len(size)), "right"), strict=True)]


def adaptive_ticks(df: DataFrame, every_ms: int = 400, low_power_ms: int = 800, still_ms: int = 1000, after: int = 2, size: int = WINDOW_SIZE,
                   sample_ms: int = 20, low_power: Column | None = None, keys: Sequence[str] = ("recording_id",), ts: str = "timestamp",
                   slice_ms: int | None = SLICE_MS, slice_ticks: int = 4096) -> DataFrame:
    """Trailing windows at the device's changing interval: ``keys, pos, tick_ts, stationary, still_run, interval_ms``.

    The first tick is at the first full window of ``size`` rows. A tick whose window is stationary more than ``after`` times
    in a row is followed ``still_ms`` later; others ``every_ms`` later, or ``low_power_ms`` where ``low_power`` holds in the tick's row.
    ``pos`` is the tick's row, ``still_run`` counts stationary ticks in a row (up to ``after + 1``). Intervals are
    counted in rows of ``sample_ms``, as in :func:`~gaitframe.operators.windows.inference_ticks`; a tick looks back over pauses.

    The rows are reduced once to blocks of the common step; the windows of all possible ticks are sums of blocks. Null channels
    count as no motion of the gyroscope and leave their row out of the variance. Runs jobs.
    """
    keys, steps = list(keys), [ms // sample_ms for ms in (every_ms, low_power_ms, still_ms)]
    unit = gcd(*steps, size)
    if unit % 2 or min(steps) <= 0 or any(ms % sample_ms for ms in (every_ms, low_power_ms, still_ms)):
        raise ValueError("intervals must be multiples of two samples that divide the window evenly")
    every, low, still = (s // unit for s in steps)
    reach, blocks = max(every, low, still), size // unit
    rows = ordered_position(df.withColumn("_low", F.lit(False) if low_power is None else low_power), keys, [ts], time_slice(ts, slice_ms))
    even, acc = F.col("pos") % 2 == 0, C.acc_magnitude()
    turn = F.abs("gx") + F.abs("gy") + F.abs("gz")
    parts = rows.groupBy(*keys, F.floor(F.col("pos") / unit).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(even, acc)).alias("m"), F.sum(F.when(even, acc)).alias("s1"), F.sum(F.when(even, acc * acc)).alias("s2"),
        F.max(F.when(even, turn)).alias("g"), F.max(F.struct("pos", ts, "_low")).alias("last"))
    first = F.greatest(F.lit(0).cast("long"), F.col("b") - (blocks - 1))
    held = parts.withColumn("j", F.explode(F.sequence(first, F.col("b")))).groupBy(*keys, "j").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("g").alias("g"), F.max("last").alias("last"))
    spread = F.col("s2") / F.col("m") - (F.col("s1") / F.col("m")) ** 2
    quiet = F.coalesce((F.col("m") > 0) & (spread < 0.05), F.lit(False)) & (F.coalesce("g", F.lit(0.0)) < 0.25)
    ready = held.filter(F.col("n") == size).select(
        *keys, "j", F.col(f"last.{ts}").alias("ts"), quiet.alias("still"), F.when(F.col("last._low"), low).otherwise(every).alias("step"))
    slices = ready.groupBy(*keys, F.floor(F.col("j") / slice_ticks).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("j", "ts", "still", "step"))).alias("c"))
    slices = materialize(slices, "tick-slices")

    @F.pandas_udf("array<int>")
    def table(calm: pd.Series, step: pd.Series) -> pd.Series:
        made = [tick_tables(calm[i:i + _ROWS].tolist(), step[i:i + _ROWS].tolist(), still, after, reach) for i in range(0, len(calm), _ROWS)]
        return pd.Series([row for part in made for row in part.astype(np.int32)])

    @F.pandas_udf("array<struct<at:int,run:int,jump:int>>")
    def walk(calm: pd.Series, step: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(calm), _ROWS):
            ticks = tick_walk(calm[i:i + _ROWS].tolist(), step[i:i + _ROWS].tolist(), entry[i:i + _ROWS].to_numpy().copy(), still, after)
            out += [[{"at": a, "run": r, "jump": j} for a, r, j in row] for row in ticks]
        return pd.Series(out)

    maps = slices.select(*keys, "slice", table("c.still", "c.step").alias("t"))
    entries = entry_states(maps, keys, "slice", "t", reach * (after + 1))
    walked = join_on(slices, entries, [*keys, "slice"]).withColumn("w", walk("c.still", "c.step", "entry"))
    ticks = walked.select(*keys, "c", F.explode("w").alias("w")).select(*keys, F.get("c", F.col("w.at")).alias("r"), "w")
    return ticks.select(*keys, (F.col("r.j") * unit + (size - 1)).alias("pos"), F.col("r.ts").alias("tick_ts"), F.col("r.still").alias("stationary"),
                        F.col("w.run").alias("still_run"), (F.col("w.jump") * (unit * sample_ms)).alias("interval_ms"))
