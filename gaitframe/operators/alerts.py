"""Alerts, contacts, escalation, history, calibration and recording progress."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.functions import columns as C
from gaitframe.operators.detector import PRESETS
from gaitframe.operators.joins import asof
from gaitframe.operators.ordered import add_segments, carry_forward, ordered_position, time_slice
from gaitframe.operators.stepping import entry_states, join_on
from gaitframe.schema import ALERT_OUTCOMES, ALERT_SCHEMA, CONTACT_SCHEMA, SLICE_MS
from gaitframe.session import materialize

HISTORY_LIMIT = 100
COUNTDOWN_SECONDS = 30
RESTING_PEAK = 9.8


def parse_alerts(df: DataFrame, column: str = "alerts_json", now_ms: Column | None = None) -> DataFrame:
    """One row per alert of a JSON array; missing fields get their defaults, an unknown outcome
    becomes DISMISSED_SAFE, a missing id is made up."""
    other = [c for c in df.columns if c != column]
    rows = df.select(*other, F.inline(F.from_json(column, T.ArrayType(ALERT_SCHEMA))))
    outcome = F.when(F.col("outcome").isin(ALERT_OUTCOMES), F.col("outcome")).otherwise(ALERT_OUTCOMES[0])
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return rows.withColumns({
        "id": F.coalesce("id", F.uuid()), "timestamp": F.coalesce(F.col("timestamp"), now), "outcome": outcome,
        "summary": F.coalesce("summary", F.lit("")), "impactForce": F.coalesce("impactForce", F.lit(0.0)),
        "tiltAngle": F.coalesce("tiltAngle", F.lit(0.0)), "confidencePct": F.coalesce("confidencePct", F.lit(0)),
        "activityBeforeFall": F.coalesce("activityBeforeFall", F.lit("walking"))})


def alert_history(df: DataFrame, limit: int = HISTORY_LIMIT, device: str = "device_id") -> DataFrame:
    """Latest ``limit`` alerts per device, newest first (``place`` from 1).

    Every map task keeps ``limit`` rows per device before the shuffle (window group limit).
    """
    newest = Window.partitionBy(device).orderBy(F.desc("timestamp"), "id")
    ranked = df.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    title = (F.when(F.col("outcome") == "DISMISSED_SAFE", "Safety Check-In")
             .when(F.col("outcome") == "SOS_DISPATCHED", "Emergency SOS Dispatched").otherwise("False Motion Filtered"))
    return ranked.withColumn("title", title)


def alerts_to_json(df: DataFrame, limit: int = HISTORY_LIMIT, device: str = "device_id") -> DataFrame:
    """One JSON array per device, newest first, of the stored history (``limit`` alerts)."""
    fields = F.struct(*ALERT_SCHEMA.fieldNames()).alias("alert")
    kept = alert_history(df, limit, device).select(device, "place", fields)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "alert"))), lambda x: x["alert"])
    return kept.groupBy(device).agg(F.to_json(listed).alias("alerts_json"))


def parse_contacts(df: DataFrame, column: str = "contacts_json") -> DataFrame:
    """One row per contact with its ``position``; names trimmed, phones without blanks and dashes,
    contacts with an empty name or phone rejected."""
    other = [c for c in df.columns if c != column]
    rows = df.select(*other, F.posexplode(F.from_json(column, T.ArrayType(CONTACT_SCHEMA))).alias("_pos", "c"))
    rows = rows.select(*other, "_pos", F.col("c.id").alias("id"), F.trim("c.name").alias("name"),
                       F.translate(F.trim("c.phone"), " -", "").alias("phone"))
    kept = rows.filter((F.length("name") > 0) & (F.length("phone") > 0))
    place = F.row_number().over(Window.partitionBy(*other).orderBy("_pos")) - 1
    return kept.withColumn("position", place).drop("_pos")


def with_sos_body(alerts: DataFrame, sender: str = "motion monitor") -> DataFrame:
    return alerts.withColumn("body", C.sos_body("timestamp", "latitude", "longitude", sender))


def newest_fix(fixes: DataFrame, keys: Sequence[str] = ("alert_id",)) -> DataFrame:
    """The newer of several position fixes; on a tie the network fix."""
    by = F.struct("fix_ts", (F.col("provider") == "network").alias("n"))
    best = F.max_by(F.struct("latitude", "longitude"), by).alias("f")
    return fixes.groupBy(*keys).agg(best).select(*keys, "f.*")


def escalation_messages(alerts: DataFrame, contacts: DataFrame, device: str = "device_id") -> DataFrame:
    """An SMS row for every contact of the device and a call row for the first one."""
    kinds = F.when(F.col("position") == 0, F.array(F.lit("sms"), F.lit("call"))).otherwise(F.array(F.lit("sms")))
    people = contacts.select(device, "position", "name", "phone", kinds.alias("kinds"))
    return alerts.join(people, device).withColumn("kind", F.explode("kinds")).drop("kinds")


def dispatch_summary(contacts: DataFrame, device: str = "device_id") -> DataFrame:
    primary = F.min_by("name", "position")
    n = F.count(F.lit(1)).cast("string")
    return contacts.groupBy(device).agg(
        F.concat(F.lit("SOS Dispatched: Call initiated to "), primary, F.lit(". SMS sent to "), n, F.lit(" of "), n,
                 F.lit(" contacts.")).alias("summary"))


def escalate(alerts: DataFrame, responses: DataFrame, countdown_s: int = COUNTDOWN_SECONDS, device: str = "device_id",
             slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Outcome of every confirmed fall.

    The first response within the countdown decides: ``dismiss`` gives DISMISSED_SAFE, ``sos``
    dispatches at once, ``stop`` (monitoring ended) gives CANCELLED_EARLY. Without one, help is
    sent when the countdown ends. Alerts and responses meet as an as-of lookup, not as pairs.
    """
    answer = responses.select(device, "timestamp", F.col("timestamp").alias("answered_at"), "action")
    rows = asof(alerts, answer, [device], ["answered_at", "action"], forward=True, slice_ms=slice_ms)
    deadline = F.col("timestamp") + countdown_s * 1000
    in_time = F.coalesce(F.col("answered_at") <= deadline, F.lit(False))
    outcome = (F.when(in_time & (F.col("action") == "dismiss"), "DISMISSED_SAFE")
               .when(in_time & (F.col("action") == "stop"), "CANCELLED_EARLY").otherwise("SOS_DISPATCHED"))
    return rows.withColumn("decided_at", F.when(in_time, F.col("answered_at")).otherwise(deadline)).withColumn(
        "outcome", outcome).drop("answered_at", "action")


def confidence_pct(p: Column | str) -> Column:
    return F.floor(C.col(p) * 100).cast("int")


def with_relative_age(df: DataFrame, now_ms: Column, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("age", C.relative_age(ts, now_ms))


def calibrate(df: DataFrame, preset: str = "desk_safe", custom_spike: float = 24.0, keys: Sequence[str] = ("recording_id",),
              ts: str = "timestamp", reset: str = "reset") -> DataFrame:
    """Running peak of ``acc`` since the last reset, starting at 9.8, and whether it reaches the
    preset's impact threshold. A reset row itself reads 9.8 or its own value."""
    threshold = custom_spike if preset == "custom" else PRESETS.get(preset, PRESETS["desk_safe"])[0]
    rows = carry_forward(df, keys, [ts], {"_since": F.when(F.col(reset), F.col(ts))}, time_slice(ts))
    rows = rows.withColumn("_since", F.coalesce("_since", F.lit(-1))).withColumn("_slice", time_slice(ts))
    group = [*keys, "_since"]
    upto = Window.partitionBy(*group, "_slice").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*group, "_slice").agg(F.max("acc").alias("_m")).withColumn(
        "_m", F.max("_m").over(before)).filter(F.col("_m").isNotNull())
    local = rows.withColumn("_here", F.max("acc").over(upto))
    peak = F.greatest(F.col("_here"), F.coalesce("_m", F.lit(RESTING_PEAK)), F.lit(RESTING_PEAK))
    return local.join(carried, [*group, "_slice"], "left").withColumn("peak", peak).withColumn(
        "high_impact", F.col("peak") >= threshold).select(*df.columns, "peak", "high_impact")


def _next_emits(clock: np.ndarray, every_ms: int) -> np.ndarray:
    """For each clock the place of the first one at least ``every_ms`` later."""
    return np.searchsorted(clock, clock + every_ms, side="left")


def _emits(clock: np.ndarray, after: int, every_ms: int) -> np.ndarray:
    """Places of the clocks emitted when the last one before them was at ``after``."""
    step, out, i = _next_emits(clock, every_ms), [], int(np.searchsorted(clock, after + every_ms, side="left"))
    while i < len(clock):
        out.append(i)
        i = int(step[i])
    return np.array(out, dtype=np.int32)


def _last_emits(clock: np.ndarray, begin: int, every_ms: int, slice_ms: int) -> np.ndarray:
    """What a slice from ``begin`` on makes of each state before it. State ``i`` says that the last emission was at
    ``begin - every_ms + i`` (0: then or earlier); the state after is that at the next slice's begin."""
    first = np.searchsorted(clock, begin + np.arange(every_ms), side="left")
    step = np.append(_next_emits(clock, every_ms), len(clock))
    last = np.arange(len(clock) + 1)
    for i in range(len(clock) - 1, -1, -1):
        last[i] = last[step[i]] if step[i] < len(clock) else i
    emitted = np.append(clock, begin - every_ms)[last[first]]
    return np.maximum(emitted - (begin + slice_ms - every_ms), 0)


def throttle(df: DataFrame, every_ms: int = 100, keys: Sequence[str] = ("recording_id",), ts: str = "timestamp",
             slice_ms: int = 600_000) -> DataFrame:
    """At most one row per ``every_ms``: a row is emitted when that much has passed since the last emitted one.
    Of rows of one clock the smallest is emitted; rows without a clock are dropped.

    A key is cut into slices of ``slice_ms`` (never less than ``every_ms``). What a slice emits depends on the last emission before it
    only, which matters for ``every_ms`` values at most, so slices are tables of states that are composed in
    logarithmic rounds (:func:`~gaitframe.operators.stepping.entry_states`), and every slice is run once from its known start. Runs jobs.
    """
    slice_ms = max(slice_ms, every_ms)
    keys, others = list(keys), [c for c in df.columns if c not in (*keys, ts)]
    number, clock = F.floor(F.col(ts) / slice_ms).cast("long"), F.transform("_rows", lambda r: r[ts].cast("long"))
    slices = df.filter(F.col(ts).isNotNull()).groupBy(*keys, number.alias("_slice")).agg(
        F.sort_array(F.collect_list(F.struct(ts, *others))).alias("_rows"))
    slices = materialize(slices, "throttle-slices")

    @F.pandas_udf("array<int>")
    def table(clock: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([_last_emits(np.asarray(c), n * slice_ms, every_ms, slice_ms).astype(np.int32) for c, n in zip(clock, number, strict=True)])

    @F.pandas_udf("array<int>")
    def emits(clock: pd.Series, number: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_emits(np.asarray(c), n * slice_ms - every_ms + e, every_ms) for c, n, e in zip(clock, number, entry, strict=True)])

    maps = slices.select(*keys, "_slice", table(clock, "_slice").alias("_table"))
    entries = entry_states(maps, keys, "_slice", "_table", every_ms, gap=0)
    kept = join_on(slices, entries, [*keys, "_slice"]).withColumn("_at", emits(clock, "_slice", "entry"))
    picked = kept.select(*keys, F.explode(F.transform("_at", lambda i: F.get("_rows", i))).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def recording_progress(df: DataFrame, every: int = 10, keys: Sequence[str] = ("recording_id",), ts: str = "timestamp",
                       slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Every tenth sample: how many so far, and full seconds since the start of the recording."""
    rows = ordered_position(df.select(*keys, ts), keys, [ts], time_slice(ts, slice_ms), out="_n")
    began = rows.groupBy(*keys).agg(F.min(ts).alias("_began"))
    seconds = F.floor((F.col(ts) - F.col("_began")) / 1000)
    return rows.filter((F.col("_n") + 1) % every == 0).join(began, list(keys)).select(
        *keys, ts, (F.col("_n") + 1).alias("samples"), seconds.alias("seconds"), C.clock_mm_ss(seconds).alias("elapsed"))
