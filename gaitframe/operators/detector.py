"""Fall confirmation: sensitivity presets and the five-phase detector over ticks.

The detector's rules are a small step function, used by the stateful stream and by the batch
twin. The batch twin does not put a device's whole life in one group: once no tick has started or
prolonged a suspicion for longer than all phase limits together, the detector is idle again, and
the next quiet tick gives it a fresh gravity baseline. Ticks between such points form
independent episodes. Episodes are not gathered either: their ticks pass in order through sorted
partitions, so a device that never calms costs time but no memory.
"""

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitframe.operators.ordered import carry_forward, time_slice
from gaitframe.schema import SLICE_MS

# Spike, free fall, dip required, model confidence, tilt, still windows per preset.
PRESET_COLUMNS = ("preset string, spike double, freefall double, dip_required boolean, fall_conf double, "
                  "min_tilt double, still_windows int")
PRESETS = {
    "desk_safe": (26.0, 5.5, True, 0.45, 32.0, 3),
    "balanced": (22.0, 6.5, False, 0.35, 28.0, 2),
    "high": (18.0, 7.5, False, 0.30, 20.0, 2),
}
# Remaining limits of the detector, in m/s², rad/s and ms.
GYRO_SPIKE, START_GYRO, QUIET_STD, REST_STD, LYING_CONF = 1.8, 1.2, 2.0, 1.2, 0.40
IMPACT_SHARE, PHASE_LIMIT_MS, REST_LIMIT_MS = 0.75, 2500, 4500

IDLE, SUDDEN, ROTATION, IMPACT, CONFIRMED = "IDLE", "PHASE1_SUDDEN_MOVEMENT", "PHASE2_ROTATION", "PHASE3_IMPACT", "CONFIRMED"
TICK_COLUMNS = ["tick_ts", "label", "p_fall", "p_lying", "acc_peak", "acc_min", "gyr_peak", "acc_std", "ox", "oy", "oz"]
START = (IDLE, 0, 0, 0.0, 1.0, 0.0, -1)


def preset(name: str, spike: float = 24.0, dip_required: bool = True, still_seconds: float = 1.5) -> tuple:
    """Thresholds by name; ``custom`` is made from the three arguments, other names are balanced."""
    if name == "custom":
        windows = max(1, math.floor(still_seconds / 0.4 + 0.5))
        return (spike, 5.5 if dip_required else 7.0, dip_required, 0.40, 28.0, windows)
    return PRESETS.get(name, PRESETS["balanced"])


def presets(spark: SparkSession, **custom) -> DataFrame:
    rows = [(n, *v) for n, v in PRESETS.items()] + [("custom", *preset("custom", **custom))]
    return spark.createDataFrame(rows, PRESET_COLUMNS)


def step(state: tuple, tick: tuple, limits: tuple) -> tuple:
    """State after one tick; at most one change of phase."""
    phase, entered, still, gx, gy, gz, _ = state
    now, label, p_fall, p_lying, peak, low, gyr, std, ox, oy, oz = tick
    spike, freefall, dip_required, fall_conf, min_tilt, still_windows = limits
    fall = label == "falling" or p_fall >= fall_conf
    dip = low < freefall
    idle = (IDLE, 0, 0, gx, gy, gz, now)
    same = (phase, entered, still, gx, gy, gz, now)

    def enter(new):
        return (new, now, 0, gx, gy, gz, now)

    if phase == IDLE:
        if not fall and std < QUIET_STD:
            gx, gy, gz = ox, oy, oz
        starts = dip and peak >= IMPACT_SHARE * spike if dip_required else peak > spike or (dip and gyr > START_GYRO)
        return enter(SUDDEN) if starts else (IDLE, 0, 0, gx, gy, gz, now)
    if phase == CONFIRMED:
        return same
    if now - entered > (REST_LIMIT_MS if phase == IMPACT else PHASE_LIMIT_MS):
        return idle
    if phase == SUDDEN:
        if gyr > GYRO_SPIKE:
            return enter(ROTATION)
        return (phase, now, still, gx, gy, gz, now) if peak > spike else same
    if phase == ROTATION:
        return enter(IMPACT) if fall and peak > IMPACT_SHARE * spike else same
    if label in ("walking", "running") and std > QUIET_STD:
        return idle
    tilt = math.degrees(math.acos(max(-1.0, min(1.0, gx * ox + gy * oy + gz * oz))))
    if label == "lying" or p_lying >= LYING_CONF or (std < REST_STD and tilt >= min_tilt):
        return enter(CONFIRMED) if still + 1 >= still_windows else (phase, entered, still + 1, gx, gy, gz, now)
    return (phase, entered, 0, gx, gy, gz, now) if std > QUIET_STD else same


def run_ticks(state: tuple, ticks: pd.DataFrame, limits: tuple, cooldown_ms: int | None = None,
              starts: Iterable[bool] | None = None) -> tuple[tuple, pd.DataFrame]:
    """Feed ordered ticks to the detector. ``cooldown_ms`` after confirming, the alert has been
    escalated and the detector is reset; ``None`` keeps it confirmed. ``starts`` marks the ticks
    that begin anew from :data:`START`."""
    out = []
    rows = ticks[TICK_COLUMNS].itertuples(index=False, name=None)
    state = _run(state, zip(rows, starts if starts is not None else repeat(False)), limits, cooldown_ms, out)
    return state, pd.DataFrame(out, columns=TRACE_COLUMNS)


def run_devices(states: Sequence[tuple], at: Sequence[int], ticks: pd.DataFrame, limits: tuple,
                cooldown_ms: int | None = None) -> tuple[list[tuple], pd.DataFrame]:
    """:func:`run_ticks` for many devices: ticks ``at[i]`` to ``at[i + 1]`` go on from ``states[i]``."""
    out = []
    rows = zip(ticks[TICK_COLUMNS].itertuples(index=False, name=None), repeat(False))
    after = [_run(tuple(s), islice(rows, int(n)), limits, cooldown_ms, out) for s, n in zip(states, np.diff(at))]
    return after, pd.DataFrame(out, columns=TRACE_COLUMNS)


def _run(state: tuple, ticks: Iterable[tuple[tuple, bool]], limits: tuple, cooldown_ms: int | None, out: list[tuple]) -> tuple:
    for tick, new in ticks:
        if new:
            state = START
        if state[0] == CONFIRMED and cooldown_ms is not None and tick[0] - state[1] > cooldown_ms:
            state = (IDLE, 0, 0, *state[3:])
        before, state = state[0], step(state, tick, limits)
        gx, gy, gz = state[3:6]
        tilt = math.degrees(math.acos(max(-1.0, min(1.0, gx * tick[8] + gy * tick[9] + gz * tick[10]))))
        out.append((tick[0], before, state[0], state[2], tick[4], tilt, tick[2], tick[1]))
    return state


TRACE_COLUMNS = ["tick_ts", "from_phase", "phase", "still", "acc_peak", "tilt", "p_fall", "label"]
TRACE_SCHEMA = ("tick_ts long, from_phase string, phase string, still int, acc_peak double, tilt double, "
                "p_fall double, label string")


def as_ticks(ticks: DataFrame, label: Column | str = "label", p_fall: Column | float = 0.0, p_lying: Column | float = 0.0) -> DataFrame:
    """Detector input from :func:`with_device_flags` output."""
    def number(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    return ticks.withColumns({
        "label": label if isinstance(label, Column) else F.col(label), "p_fall": number(p_fall), "p_lying": number(p_lying),
        "ox": F.col("orientation.x"), "oy": F.col("orientation.y"), "oz": F.col("orientation.z")})


def episodes(ticks: DataFrame, limits: tuple, keys: Sequence[str], cooldown_ms: int, slot_ms: int = SLICE_MS,
             slice_ms: int | None = SLICE_MS) -> DataFrame:
    """``episode`` per tick, starting where the detector is surely idle on a quiet tick.

    Suspicion can last no longer than the phase limits and the cooldown after the last tick that
    may start or prolong it.
    """
    spike, freefall, dip_required, fall_conf, _, _ = limits
    dip = F.col("acc_min") < freefall
    starts = (dip & (F.col("acc_peak") >= IMPACT_SHARE * spike)) if dip_required else (
        (F.col("acc_peak") > spike) | (dip & (F.col("gyr_peak") > START_GYRO)))
    spark_at = F.when(starts | (F.col("acc_peak") > spike), F.col("tick_ts"))
    calm = 2 * PHASE_LIMIT_MS + REST_LIMIT_MS + cooldown_ms
    rows = carry_forward(ticks, keys, ["tick_ts"], {"_spark": spark_at}, time_slice("tick_ts", slice_ms))
    quiet = (F.col("label") != "falling") & (F.col("p_fall") < fall_conf) & (F.col("acc_std") < QUIET_STD) & ~starts
    # by the tick before this one every phase had timed out; the first such tick of a slot cuts
    slot = Window.partitionBy(*keys, F.floor(F.col("tick_ts") / slot_ms))
    before = F.lag("tick_ts").over(slot.orderBy("tick_ts"))
    settled = F.coalesce(before - F.col("_spark") > calm, F.col("_spark").isNull())
    rows = rows.withColumn("_calm", F.when(quiet & settled, F.col("tick_ts")))
    rows = rows.withColumn("_cut", F.when(F.min("_calm").over(slot) == F.col("tick_ts"), F.col("tick_ts")))
    return carry_forward(rows, keys, ["tick_ts"], {"episode": F.col("_cut")}, time_slice("tick_ts", slice_ms)).drop(
        "_cut", "_calm", "_spark").withColumn("episode", F.coalesce("episode", F.lit(-1)))


def confirm_falls(ticks: DataFrame, limits: tuple, keys: Sequence[str] = ("recording_id",), cooldown_ms: int = 30_000,
                  slot_ms: int = SLICE_MS, slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Batch twin of the streaming detector: phase before and after every tick.

    An episode's ticks stand in one partition in the order of their clocks, and only the detector's state is
    carried from one Arrow batch to the next: memory does not depend on the length of an episode.
    """
    keys = list(keys)
    group = [*keys, "episode"]
    cut = episodes(ticks, limits, keys, cooldown_ms, slot_ms, slice_ms).select(*group, *TICK_COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = START, None
        for pdf in batches:
            if pdf.empty:
                continue
            at = pdf[group]
            before = at.shift()
            starts = ((at != before) & ~(at.isna() & before.isna())).any(axis=1).to_numpy()
            first = at.iloc[:1].reset_index(drop=True)
            starts[0] = last is None or not first.equals(last)
            last = at.iloc[-1:].reset_index(drop=True)
            state, trace = run_ticks(state, pdf, limits, cooldown_ms, starts)
            yield pd.concat([pdf[keys].reset_index(drop=True), trace], axis=1)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ticks.select(*keys).schema.fields)
    return cut.repartition(*group).sortWithinPartitions(*group, "tick_ts").mapInPandas(run, f"{types}, {TRACE_SCHEMA}")


def confirmations(trace: DataFrame) -> DataFrame:
    """Ticks at which a fall was confirmed."""
    return trace.filter((F.col("phase") == CONFIRMED) & (F.col("from_phase") != CONFIRMED))

