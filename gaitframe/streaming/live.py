"""Live fusion, ticks, gates, fall confirmation and escalation as stateful streams.

Event-ordered operators keep one keyed state per bucket of devices (``transformWithState``; the session needs the RocksDB
state store, see :func:`gaitframe.streaming.replay.stream_session`), as every call to the state store costs more than the rows of
one device: a digest deals the devices to ``BUCKETS``, tasks pack their rows by bucket and slot of ``SLOT_MS`` of the rows' clock,
and a pack goes to a map state as it arrived. A slot is read once, when the watermark has passed its end, and the devices of a
bucket are processed together, each in event order, so the result does not depend on where micro-batches fall and nothing
that still waits is written again. Packs whose latest row is older than the watermark on arrival are dropped. State
holds the rows of one watermark delay and a fixed number of values per device (the escalation: open alerts, keyed by
device); event-time timers release it, and a device that has been silent for ``IDLE_MS`` is forgotten within another ``IDLE_MS``.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gaitframe.operators import detector as D
from gaitframe.operators.features import feature_names, named_features, window_features
from gaitframe.operators.models import predict, with_vector
from gaitframe.schema import SENSORS, VALID_LABELS, WINDOW_SIZE

WATERMARK = "10 seconds"
#: Silence after which a device's state is dropped.
IDLE_MS = 3_600_000
#: Buckets of devices that share a state; fixed in a checkpoint.
BUCKETS = 256
#: Rows that a task packs at a time, and devices whose states are written as one value.
PACK_ROWS, STATE_DEVICES = 500_000, 1_000
#: Rows of a bucket that are processed at a time.
CHUNK_ROWS = 50_000
#: Rows wait together by slots of their clock; results come at most this much later than the watermark.
SLOT_MS = 2_000


def stream_samples(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                   ts: str = "timestamp", watermark: str | None = None, **options) -> DataFrame:
    """Samples from files (or, with ``fmt='kafka'`` and its options, JSON records of a topic), with
    ``event_time`` made from the millisecond clock."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        rows = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    else:
        rows = spark.readStream.schema(schema).options(**options).format(fmt).load(path)
    rows = rows.withColumn("event_time", F.timestamp_millis(ts))
    return rows.withWatermark("event_time", watermark) if watermark else rows


def _types(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and slot, some hundred thousand at a time; what leads them (bucket, slot, digest, clock) orders them only."""

    def packs(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some)
        bucket, slot, digest, clock = (table.column(i).to_numpy() for i in range(4))
        order = np.lexsort((clock, digest, slot, bucket))
        bucket, slot, clock, rows = bucket[order], slot[order], clock[order], table.select(table.column_names[4:]).take(order).combine_chunks()
        starts = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(slot) != 0)])
        data = [_bytes(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(rows)])]
        latest = pa.array(np.maximum.reduceat(clock, starts) * 1000, pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(slot[starts]), latest, pa.array(data, pa.binary())], ["bucket", "slot", "event_time", "rows"])

    some, n = [], 0
    for batch in batches:
        if len(batch):
            some.append(batch)
            n += len(batch)
        if n >= PACK_ROWS:
            yield packs(some)
            some, n = [], 0
    if some:
        yield packs(some)


class _Timed(StatefulProcessor):
    """A processor with one event-time timer per key, whose time stands in the key's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, None, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def advance(self, key: tuple, rows: pd.DataFrame | None, mark: int, expired: int | None) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def move_timer(self, old: int | None, new: int | None, expired: int | None) -> None:
        """An expired timer has gone by itself."""
        if old is not None and old not in (new, expired):
            self.handle.deleteTimer(old)
        if new is not None and new != old:
            self.handle.registerTimer(new)


class _EventOrder(_Timed):
    """Packs by slot in ``held``, the devices' states in ``devices``; ``now`` counts the bucket's rows that have passed
    and has the waiting slots with their number of parts, the parts of ``devices``, the time of the next sweep, and the timer."""

    def __init__(self, device: str, ts: str, then: Sequence[str], start: tuple, step: Callable):
        self.device, self.ts, self.then, self.start, self.step = device, ts, then, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "seen long, slots array<long>, parts array<int>, written int, sweep long, timer long")
        self.devices = handle.getMapState("devices", "part int", "states binary")
        self.held = handle.getMapState("held", "slot long, part int", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        packs = (p for some in rows for p in zip(some["slot"], some["rows"]))
        yield from self.advance(key, packs, timerValues.getCurrentWatermarkInMs(), None)

    def due(self, waiting: dict[int, int], fresh: dict[int, list[bytes]], mark: int) -> Iterator[pd.DataFrame]:
        """Rows of the slots that have passed, some ten thousand at a time; they leave the state."""
        some: list[pa.Table] = []
        for slot in sorted({*waiting, *fresh}):
            if (slot + 1) * SLOT_MS > mark:
                break
            for part in range(waiting.pop(slot, 0)):
                some.append(_table(self.held.getValue((slot, part))[0]))
                self.held.removeKey((slot, part))
            some += map(_table, fresh.pop(slot, []))
            if sum(map(len, some)) >= CHUNK_ROWS:
                yield pa.concat_tables(some, promote_options="permissive")
                some = []
        if some:
            yield pa.concat_tables(some, promote_options="permissive")

    def passed(self, states: dict, table: pa.Table, until: int) -> Iterator[pd.DataFrame]:
        """Steps over some rows, device by device in event order; ``states`` goes on with them."""
        coded = table.column(self.device).combine_chunks().dictionary_encode(null_encoding="encode")
        names, rows = coded.dictionary.to_pylist(), table.to_pandas()
        code = coded.indices.to_numpy()
        order = np.lexsort((*(rows[c].to_numpy() for c in reversed(self.then)), rows[self.ts].to_numpy(), code))
        code, rows = code[order], rows.iloc[order]
        for i in range(0, len(rows), CHUNK_ROWS):
            chunk, which = rows.iloc[i:i + CHUNK_ROWS].reset_index(drop=True), code[i:i + CHUNK_ROWS]
            at = np.r_[np.flatnonzero(np.r_[True, np.diff(which) != 0]), len(which)]
            here = [names[c] for c in which[at[:-1]]]
            new, made = self.step([states[d][1:] if d in states else self.start for d in here], at, chunk)
            states.update((d, (until, *s)) for d, s in zip(here, new))
            if made is not None and len(made):
                yield made

    def read(self, written: int) -> dict:
        states = {}
        for part in range(written):
            table = _table(self.devices.getValue((part,))[0])
            values = table.drop_columns(["device"]).to_pandas()
            states.update(zip(table.column("device").to_pylist(), zip(*(values[c] for c in values.columns))))
        return states

    def write(self, states: dict, written: int) -> int:
        names, rows, parts = list(states), list(states.values()), 0
        for i in range(0, len(names), STATE_DEVICES):
            columns = [pa.array(names[i:i + STATE_DEVICES]), *map(pa.array, map(list, zip(*rows[i:i + STATE_DEVICES])))]
            self.devices.updateValue((parts,), (_bytes(pa.table(columns, names=["device", *map(str, range(len(columns) - 1))])),))
            parts += 1
        for part in range(parts, written):
            self.devices.removeKey((part,))
        return parts

    def silent(self, states: dict, waiting: dict[int, int], mark: int) -> list:
        """Devices that are silent for long and of which no row waits."""
        gone = {d for d, s in states.items() if s[0] <= mark}
        for slot, parts in waiting.items():
            for part in range(parts if gone else 0):
                gone.difference_update(_table(self.held.getValue((slot, part))[0]).column(self.device).to_pylist())
        return list(gone)

    def advance(self, key: tuple, rows: Iterator[tuple[int, bytes]] | None, mark: int, expired: int | None) -> Iterator[pd.DataFrame]:
        seen, slots, parts, written, sweep, timer = self.now.get() or (0, [], [], 0, None, None)
        waiting, fresh, states = dict(zip(slots, parts)), {}, None
        for slot, data in rows or ():
            if (slot + 1) * SLOT_MS <= mark:
                fresh.setdefault(int(slot), []).append(data)
                continue
            part = waiting.get(int(slot), 0)
            self.held.updateValue((int(slot), part), (data,))
            waiting[int(slot)] = part + 1
        until = max(mark, 0) + IDLE_MS
        for table in self.due(waiting, fresh, mark):
            states = self.read(written) if states is None else states
            seen += len(table)
            yield from self.passed(states, table, until)
        if sweep is not None and sweep <= mark:
            states, sweep = self.read(written) if states is None else states, None
            for name in self.silent(states, waiting, mark):
                del states[name]
        if states is not None:
            written = self.write(states, written)
        if not waiting and not written:
            self.now.clear()
            self.move_timer(timer, None, expired)
            return
        sweep = until if written and sweep is None else sweep
        new = min([(slot + 1) * SLOT_MS for slot in waiting] + [sweep] * (sweep is not None))
        self.move_timer(timer, new, expired)
        self.now.update((seen, list(waiting), list(waiting.values()), written, sweep, new))


def in_event_order(df: DataFrame, device: str, ts: str, out: str, start: tuple,
                   step: Callable[[list[tuple], np.ndarray, pd.DataFrame], tuple[list[tuple], pd.DataFrame | None]],
                   then: Sequence[str] = (), watermark: str = WATERMARK) -> DataFrame:
    """``step(states, at, rows)`` over the rows of many devices, each sorted by ``ts`` and ``then``, once the watermark has passed
    the slot they are of. Rows ``at[i]`` to ``at[i + 1]`` are of one device, whose state is ``states[i]`` (``start`` at first);
    the step returns the states after them. Rows without a clock are dropped."""
    digest = F.xxhash64(device)
    lead = [F.pmod(digest, F.lit(BUCKETS)).cast("int").alias("_bucket"), F.floor(F.col(ts) / SLOT_MS).alias("_slot"), digest.alias("_digest"), F.col(ts).alias("_clock")]
    packs = df.filter(F.col(ts).isNotNull()).select(*lead, *df.columns).mapInArrow(_packed, "bucket int, slot long, event_time timestamp, rows binary")
    return packs.withWatermark("event_time", watermark).groupBy("bucket").transformWithStateInPandas(
        _EventOrder(device, ts, then, start, step), out, "Append", "EventTime")


def _latest(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of the last marked row of the same device up to each row, -1 where there is none."""
    last = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    return np.where(last >= np.repeat(at[:-1], np.diff(at)), last, -1)


def stream_fuse(feed: DataFrame, device: str = "device_id", ts: str = "timestamp") -> DataFrame:
    """Accelerometer samples with the latest gyroscope reading.

    ``feed`` carries both sensors: ``sensor`` (acc or gyr), ``x``, ``y``, ``z``. A gyroscope reading
    goes before an accelerometer sample of the same millisecond.
    """
    out = f"{_types(feed, [device, ts])}, " + ", ".join(f"{c} double" for c in SENSORS)

    def fuse(states: list[tuple], at: np.ndarray, rows: pd.DataFrame) -> tuple[list[tuple], pd.DataFrame]:
        turn, counts = (rows["sensor"] == "gyr").to_numpy(), np.diff(at)
        fused, after = {device: rows[device], ts: rows[ts]}, []
        for c, g, start in zip("xyz", ("gx", "gy", "gz"), zip(*states)):
            values = rows[c].to_numpy(float)
            last = _latest(turn & ~np.isnan(values), at)
            held = np.where(last >= 0, values[last], np.repeat(start, counts))
            fused[f"a{c}"], fused[g] = values, held
            after.append(held[at[1:] - 1].tolist())
        return list(zip(*after)), pd.DataFrame(fused).loc[~turn, [device, ts, *SENSORS]]

    side = feed.withColumn("_side", (F.col("sensor") == "acc").cast("int"))
    return in_event_order(side, device, ts, out, (0.0, 0.0, 0.0), fuse, ["_side"])


METRICS = ("tick long, tick_ts long, acc_peak double, acc_min double, gyr_peak double, acc_std double, mean_ax double, "
           "mean_ay double, mean_az double, even_acc_var double, even_gyr_l1 double, even_acc_max double, "
           "even_acc_min double, last_sample struct<ay: double, az: double>")


def tick_metrics(block: np.ndarray) -> dict[str, np.ndarray]:
    """Window metrics of (ticks, size, 6) samples; the same quantities as ``device_metrics``."""
    acc = np.sqrt((block[..., :3] ** 2).sum(-1))
    gyr = np.sqrt((block[..., 3:] ** 2).sum(-1))
    even, mean = acc[:, ::2], block[..., :3].mean(1)
    return {
        "acc_peak": acc.max(1), "acc_min": acc.min(1), "gyr_peak": gyr.max(1), "acc_std": acc.std(1),
        "mean_ax": mean[:, 0], "mean_ay": mean[:, 1], "mean_az": mean[:, 2], "even_acc_var": even.var(1),
        "even_gyr_l1": np.abs(block[:, ::2, 3:]).sum(-1).max(1), "even_acc_max": even.max(1), "even_acc_min": even.min(1),
        "last_sample": [{"ay": float(b[-1, 1]), "az": float(b[-1, 2])} for b in block],
    }


def stream_ticks(samples: DataFrame, size: int = WINDOW_SIZE, every_ms: int = 400, sample_ms: int = 20,
                 device: str = "device_id", ts: str = "timestamp", features: str | None = None) -> DataFrame:
    """Metrics of the latest ``size`` samples at every tick; the last samples are kept as state.

    ``features`` names a column for the 134 window features (an array), which :func:`classify_ticks` takes.
    """
    step = every_ms // sample_ms
    width = len(SENSORS)

    def tick(states: list[tuple], at: np.ndarray, rows: pd.DataFrame) -> tuple[list[tuple], pd.DataFrame | None]:
        old, counts = [np.asarray(kept, dtype=float).reshape(-1, width) for kept, _ in states], np.diff(at)
        fresh, clock, made = rows[SENSORS].to_numpy(float), rows[ts].to_numpy(), None
        data = np.concatenate([part for i, kept in enumerate(old) for part in (kept, fresh[at[i]:at[i + 1]])])
        seen, carried = np.array([n for _, n in states], dtype=np.int64), np.array([len(kept) for kept in old])
        end, stop = seen + counts, np.cumsum(carried + counts)      # one past the last row held: its number and place
        number = np.maximum(0, -(-(seen - size + 1) // step))       # first tick that ends in these rows
        ticks = np.maximum((end - size) // step - number + 1, 0)
        which = np.repeat(np.arange(len(ticks)), ticks)
        if len(which):
            numbers = number[which] + np.arange(len(which)) - (np.cumsum(ticks) - ticks)[which]
            back = end[which] - (numbers * step + size)             # rows after the tick's last one
            block = data[(stop[which] - back - size)[:, None] + np.arange(size)]
            last = at[1:][which] - 1 - back
            made = pd.DataFrame({device: rows[device].to_numpy()[last], "tick": numbers, "tick_ts": clock[last], **tick_metrics(block)})
            if features:
                made[features] = list(window_features(block.transpose(0, 2, 1)))
        kept = np.minimum(carried + counts, size - 1)
        return [(data[b - n:b].ravel(), int(e)) for b, n, e in zip(stop, kept, end)], made

    out = f"{_types(samples, [device])}, {METRICS}" + (f", {features} array<double>" if features else "")
    return in_event_order(samples, device, ts, out, ([], 0), tick)


def classify_ticks(ticks: DataFrame, model: PipelineModel, features: str = "features_134") -> DataFrame:
    """Ticks with the model's label and probabilities, as :func:`stream_gates` takes them (works on streams)."""
    scored = predict(model, with_vector(named_features(ticks, features))).drop(*feature_names())
    return scored.withColumnsRenamed({"prediction": "model_label", "probabilities": "model_probs"})


def stream_gates(ticks: DataFrame, classes: Sequence[str] = tuple(VALID_LABELS), device: str = "device_id") -> DataFrame:
    """Final label, probabilities and deciding gate per tick (stream twin of ``on_device_gates``).

    The model's ``model_label`` and ``model_probs`` come from ``PipelineModel.transform``, which
    works on streams. State is the number of still ticks in a row.
    """
    classes = list(classes)
    keep = [c for c in ticks.columns if c in ("tick", "tick_ts")]
    out = f"{_types(ticks, [device, *keep])}, still_ticks long, gate string, label string, confidence double, probabilities array<double>"

    def gate(states: list[tuple], at: np.ndarray, rows: pd.DataFrame) -> tuple[list[tuple], pd.DataFrame]:
        calm, place = rows["stationary"].to_numpy(bool), np.arange(len(rows))
        moved, counts = _latest(~calm, at), np.diff(at)
        before = place - np.repeat(at[:-1], counts) + 1 + np.repeat([still for still, in states], counts)
        runs = pd.Series(np.where(moved >= 0, place - moved, before), index=rows.index)
        rest, gentle = runs > 2, rows["low_power"] & rows["gentle"]
        label = rows["model_label"].where(~gentle, "walking").where(~rest, rows["posture"])
        probs = [
            [0.95 if c == lb else 0.01 for c in classes] if r else [0.88 if c == lb else 0.02 for c in classes] if g else list(p)
            for r, g, lb, p in zip(rest, gentle, label, rows["model_probs"])]
        return [(int(n),) for n in runs.to_numpy()[at[1:] - 1]], rows[[device, *keep]].assign(**{
            "still_ticks": runs, "gate": np.select([rest, gentle], ["rest", "gentle"], "model"), "label": label,
            "confidence": [max(p) for p in probs], "probabilities": probs})

    return in_event_order(ticks, device, "tick_ts", out, (0,), gate)


def stream_confirm(ticks: DataFrame, limits: tuple, device: str = "device_id", cooldown_ms: int | None = 30_000) -> DataFrame:
    """Phase of the fall detector after every tick; state is the detector's state."""

    def confirm(states: list[tuple], at: np.ndarray, rows: pd.DataFrame) -> tuple[list[tuple], pd.DataFrame]:
        after, trace = D.run_devices(states, at, rows, limits, cooldown_ms)
        trace.insert(0, device, rows[device])
        return after, trace

    return in_event_order(ticks, device, "tick_ts", f"{_types(ticks, [device])}, {D.TRACE_SCHEMA}", D.START, confirm)


class _Escalation(_Timed):
    """Open alerts of a device as list state; the timer stands at the first deadline."""

    def __init__(self, device: str, limit: int):
        self.device, self.limit = device, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "id string, started long")
        self.timer = handle.getValueState("timer", "at long")

    def advance(self, key: tuple, rows: pd.DataFrame | None, mark: int, expired: int | None) -> Iterator[pd.DataFrame]:
        outcome = {"dismiss": "DISMISSED_SAFE", "stop": "CANCELLED_EARLY", "sos": "SOS_DISPATCHED"}
        known = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        waiting, done = list(known), []
        if rows is not None:
            rows = rows.assign(_side=(rows["action"] != "alert").astype(int)).sort_values(["timestamp", "_side"], kind="stable")
            for ts, action, alert in rows[["timestamp", "action", "id"]].itertuples(index=False, name=None):
                if action == "alert":
                    waiting.append((alert, int(ts)))
                    continue
                done += [(i, s + self.limit, "SOS_DISPATCHED") if ts > s + self.limit else (i, int(ts), outcome[action]) for i, s in waiting]
                waiting = []
        done += [(i, s + self.limit, "SOS_DISPATCHED") for i, s in waiting if s + self.limit <= mark]
        waiting = [(i, s) for i, s in waiting if s + self.limit > mark]
        if waiting[:len(known)] == known:
            if len(waiting) > len(known):
                self.open.appendList(waiting[len(known):])
        elif waiting:
            self.open.put(waiting)
        else:
            self.open.clear()
        at = self.timer.get()
        new = min(s for _, s in waiting) + self.limit if waiting else None
        self.move_timer(at[0] if at else None, new, expired)
        if new is not None:
            self.timer.update((new,))
        elif at:
            self.timer.clear()
        if done:
            yield pd.DataFrame(done, columns=["id", "decided_at", "outcome"]).assign(**{self.device: key[0]})


def stream_escalate(events: DataFrame, countdown_s: int = 30, device: str = "device_id", watermark: str = WATERMARK) -> DataFrame:
    """Outcome of every alert, at the first answer or when the countdown ends in event time.

    ``events`` mixes alerts (``action`` alert, with ``id``) and answers (dismiss, sos, stop) and has
    ``event_time``. Open alerts of a device wait in state until answered or overdue.
    """
    return events.withWatermark("event_time", watermark).groupBy(device).transformWithStateInPandas(
        _Escalation(device, countdown_s * 1000), f"{_types(events, [device])}, id string, decided_at long, outcome string",
        "Append", "EventTime")


def archive_batches(path: str):
    """``foreachBatch`` function that archives confirmed windows. A batch that is run again
    overwrites its own folder, so a restart leaves no copies."""
    from gaitframe.sources.sinks import archive_rows

    def write(batch: DataFrame, batch_id: int) -> None:
        archive_rows(batch).drop("recording_id").write.mode("overwrite").partitionBy("status", "archive_label").option(
            "header", True).csv(f"{path}/batch={batch_id}")

    return write


def activity_summary(labels: DataFrame, every: str = "1 minute", watermark: str = WATERMARK, device: str = "device_id") -> DataFrame:
    """Ticks per device, label and tumbling interval of event time; late rows are dropped."""
    return (labels.withWatermark("event_time", watermark).groupBy(device, F.window("event_time", every), "label")
            .agg(F.count(F.lit(1)).alias("n_ticks"))
            .select(device, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "label", "n_ticks"))


def activity_sessions(labels: DataFrame, gap: str = "30 seconds", watermark: str = WATERMARK, device: str = "device_id") -> DataFrame:
    """Uninterrupted stretches of activity per device."""
    return (labels.withWatermark("event_time", watermark).groupBy(device, F.session_window("event_time", gap))
            .agg(F.count(F.lit(1)).alias("n_ticks"))
            .select(device, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_ticks"))
