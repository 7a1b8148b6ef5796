"""Order-dependent operators that do not put a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts all rows of a key in one task. The
operators here order rows inside (key, slice), where ``slice`` is any expression that grows with
the order, reduce every slice to one summary row, run the window over the summaries, and join
the carried value back. Summary rows that carry nothing are dropped before the join: a key with
a single slice costs no more than the plain window, and the joined side stays small enough for
adaptive execution to broadcast it.
"""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.schema import PAUSE_MS, SLICE_MS
from gaitframe.session import materialize


def time_slice(ts: str = "timestamp", slice_ms: int | None = SLICE_MS) -> Column | None:
    """Slice number of a growing numeric column. ``slice_ms=None`` stands for no slices: the caller
    knows a bound on the rows of a key."""
    return None if slice_ms is None else F.floor(F.col(ts) / F.lit(slice_ms))


def digest_slice(digest: Column) -> Column:
    """Slice of a hexadecimal digest: its first four digits, in digest order."""
    return F.substring(digest, 1, 4)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribute by (key, slice).

    The window over (key, slice) needs this exchange anyway, but would take rows that an earlier
    join left distributed by the key alone as they are, with a whole hot key in one task.
    """
    return df.repartition(*keys, "_slice")


def ordered_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                     slice_by: Column | None, out: str = "pos") -> DataFrame:
    """0-based position of every row inside its key. ``keys`` may be empty (one global order).

    ``slice_by=None`` is for keys of proven size: they are ordered in one piece.
    """
    keys = list(keys)
    if slice_by is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    sliced = df.withColumn("_slice", slice_by)
    local = spread(sliced, keys).withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_base", F.sum("_rows").over(before)).drop("_rows")
        .filter(F.col("_base") > 0)
    )
    return (
        local.join(base, [*keys, "_slice"], "left")
        .withColumn(out, F.col("_local") - 1 + F.coalesce("_base", F.lit(0)))
        .drop("_slice", "_local", "_base")
    )


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  columns: dict[str, Column], slice_by: Column | None,
                  descending: bool = False) -> DataFrame:
    """Adds, for each name, the latest non-null value of its column at or before the row.

    ``descending=True`` looks at or after the row instead. ``slice_by=None`` is for keys of
    proven size.
    """
    keys, names = list(keys), list(columns)
    if slice_by is None:
        ordering = [F.desc(c) if descending else F.asc(c) for c in order]
        w = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.last(v, ignorenulls=True).over(w).alias(n) for n, v in columns.items()])
    sliced = df.withColumn("_slice", slice_by)
    for name, value in columns.items():
        sliced = sliced.withColumn(f"_v_{name}", value)
    ordering = [F.desc(c) if descending else F.asc(c) for c in order]
    running = (Window.partitionBy(*keys, "_slice").orderBy(*ordering)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = spread(sliced, keys).select(
        "*", *[F.last(f"_v_{n}", ignorenulls=True).over(running).alias(f"_l_{n}") for n in names])
    pick = F.min_by if descending else F.max_by
    by = F.struct(*order)
    ends = sliced.groupBy(*keys, "_slice").agg(
        *[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), by)).alias(f"_e_{n}") for n in names])
    step = F.desc("_slice") if descending else F.asc("_slice")
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_slice",
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in names]
    ).filter(reduce(or_, [F.col(f"_c_{n}").isNotNull() for n in names]))
    joined = local.join(carried, [*keys, "_slice"], "left")
    for n in names:
        joined = joined.withColumn(n, F.coalesce(f"_l_{n}", f"_c_{n}"))
    return joined.drop("_slice", *[f"_{p}_{n}" for p in "vlc" for n in names])


def add_segments(df: DataFrame, keys: Sequence[str] = ("recording_id",), ts: str = "timestamp",
                 gap_ms: int = PAUSE_MS, slice_ms: int | None = SLICE_MS) -> DataFrame:
    """Pause segmentation: ``segment`` counts pauses longer than ``gap_ms`` inside a recording,
    ``pos`` is the 0-based position of the row inside its segment.

    ``slice_ms=None`` is for recordings of proven length: they are ordered in one piece.
    """
    keys = list(keys)
    rows = df if slice_ms is None else spread(df.withColumn("_slice", time_slice(ts, slice_ms)), keys)
    w = Window.partitionBy(*keys, *([] if slice_ms is None else ["_slice"])).orderBy(ts)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.row_number().over(w).alias("_rn"),
                       (F.col(ts) - F.lag(ts).over(w)).alias("_dt"))
    rows = rows.withColumn("_cut", F.coalesce(F.col("_dt") > gap_ms, F.lit(False)))
    rows = rows.select(
        "*", F.sum(F.col("_cut").cast("int")).over(upto).alias("_cuts"),
        F.max(F.when(F.col("_cut"), F.col("_rn"))).over(upto).alias("_cut_at"))
    in_slice = F.when(F.col("_cuts") == 0, F.col("_rn") - 1)
    after_cut = F.col("_rn") - F.col("_cut_at")
    if slice_ms is None:
        return (rows.withColumn("segment", F.col("_cuts").cast("int"))
                .withColumn("pos", in_slice.otherwise(after_cut).cast("long"))
                .drop("_rn", "_dt", "_cut", "_cuts", "_cut_at"))

    slices = rows.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.max("_cuts").alias("cuts"), F.max("_cut_at").alias("last_cut"))
    ws = Window.partitionBy(*keys).orderBy("_slice")
    ws_before = ws.rowsBetween(Window.unboundedPreceding, -1)
    ws_upto = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pause = F.coalesce(F.col("first_ts") - F.lag("last_ts").over(ws) > gap_ms, F.lit(False))
    slices = slices.select(
        "*", pause.alias("pause"), F.coalesce(F.sum("rows").over(ws_before), F.lit(0)).alias("base"),
        F.coalesce(F.lag("cuts").over(ws), F.lit(0)).alias("prev_cuts"))
    began = F.when(F.col("last_cut").isNotNull(), F.col("base") + F.col("last_cut") - 1).when(
        F.col("pause"), F.col("base"))
    slices = slices.withColumn("began", began)
    slices = slices.select(
        *keys, "_slice",
        F.sum(F.col("pause").cast("int") + F.col("prev_cuts")).over(ws_upto).alias("_seg0"),
        F.when(F.col("pause"), F.lit(0)).otherwise(
            F.col("base") - F.coalesce(F.last("began", ignorenulls=True).over(ws_before), F.lit(0))
        ).alias("_open"),
    ).filter((F.col("_seg0") > 0) | (F.col("_open") > 0))

    return (
        rows.join(slices, [*keys, "_slice"], "left")
        .withColumn("segment", (F.col("_cuts") + F.coalesce("_seg0", F.lit(0))).cast("int"))
        .withColumn("pos", F.when(F.col("_cuts") == 0,
                                  F.col("_rn") - 1 + F.coalesce("_open", F.lit(0)))
                    .otherwise(after_cut).cast("long"))
        .drop("_slice", "_rn", "_dt", "_cut", "_cuts", "_cut_at", "_seg0", "_open")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    width: float = 1 / 256, levels: int = 3) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per entry of ``probs`` (runs a job).

    ``percentile`` keeps every distinct value of a key in one buffer. Here a histogram of fixed
    width finds the few buckets that hold the wanted ranks; their rows are written once, and the buckets are cut
    256-fold ``levels - 1`` times, so that a million values that lie close together are not ordered in one task
    either. Only the rows of the last buckets are ordered. ``width`` is a power of two, so that cuts are exact.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    over_key = Window.partitionBy(*keys)
    before = over_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(over_key).alias("_total"))
    ranks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("_q"), F.lit(side).alias("_side"),
                 ((F.col("_total") - 1) * F.lit(float(p))).alias("_h"),
                 (F.floor if side == 0 else F.ceil)((F.col("_total") - 1) * F.lit(float(p))).alias("_rank"))
        for name, p in probs.items() for side in (0, 1)]))
    inside = (F.col("_rank") >= F.col("_base")) & (F.col("_rank") < F.col("_base") + F.col("_n"))
    rank = (F.col("_rank") - F.col("_base")).alias("_rank")
    wanted = hist.select("*", ranks.alias("_w")).select(*keys, "_b", "_base", "_n", "_w.*").filter(inside)
    wanted = materialize(wanted.select(*keys, "_b", "_q", "_side", "_h", rank), "quantile-ranks")
    rows = materialize(rows.join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi"), "quantile-rows")
    for level in range(1, levels):
        finer = rows.withColumn("_c", F.floor(F.col("_v") / (width / 256 ** level)))
        parts = finer.groupBy(*keys, "_b", "_c").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_base", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        wanted = wanted.join(parts, [*keys, "_b"]).filter(inside).select(*keys, F.col("_c").alias("_b"), "_q", "_side", "_h", rank)
        rows = finer.select(*keys, "_v", F.col("_c").alias("_b")).join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    values = (
        rows.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_hi", F.sum("_m").over(in_bucket))
        .select(*keys, "_b", "_v", (F.col("_hi") - F.col("_m")).alias("_lo"), "_hi"))
    picked = wanted.join(values, [*keys, "_b"]).filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    out = []
    for name in probs:
        here = F.col("_q") == name
        lo = F.max(F.when(here & (F.col("_side") == 0), F.col("_v")))
        hi = F.max(F.when(here & (F.col("_side") == 1), F.col("_v")))
        h = F.max(F.when(here, F.col("_h")))
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return picked.groupBy(*keys).agg(*out)
