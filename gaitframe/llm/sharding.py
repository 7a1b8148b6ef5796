"""Balanced label propagation: documents to shards of equal row counts, equal texts together where they fit.

Method. Rows start in shards dealt out one by one. In every round each group of equal texts (the links) names
the shard that holds most of it among those with room; its members elsewhere ask to move there. Moves are
granted under quotas that keep every shard's count: as many go from s to t as from t to s, and each further
one changes places with an unlinked row of t. It ends when nothing moves, which it must, as every move brings a row of a
group to a shard that holds at least as many of it: the sum of squares of the groups' counts grows. Counts therefore differ by one at
most (the ``rows`` law) whatever moves; a group larger than a shard fills several.

Scale. DataFrame operations only. Ranks within a shard come from bucket totals and a window within (shard,
bucket), so no window holds a shard; of the unlinked rows only as many buckets are ordered as places are wanted. Per-group state is a few counts, written before its members meet it, so that
Spark knows its size and may split the join by skew (it can't split a join that shares a stage with a grouping). The driver sees counts per pair of shards only. Every round is a written table.

Cases. A null text has size 1 (no bytes), crc 0 and no links; empty texts are equal to each other. Ids may be
null or repeated: every row gets a place. Fewer rows than shards leave shards empty.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaitframe.session import materialize

BUCKET_ROWS = 4_000


def _ranked(df: DataFrame, keys: list[str], buckets: int, out: str, upto: Column | None = None) -> DataFrame:
    """``df`` with its rank from 0 among the rows of equal ``keys`` (in order of bucket, then ``row``). With ``upto`` only
    buckets that begin below that rank are ordered, and the rows of the others are left out."""
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if upto is not None:
        starts = starts.filter(F.col("_start") < upto)
        cut = cut.join(starts.select(*keys, "_bucket"), [*keys, "_bucket"], "left_semi")
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("row")) - 1
    return cut.withColumn("_in", within).join(starts, [*keys, "_bucket"]).withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop(
        "_bucket", "_start", "_in")


def _table(counts: dict[tuple[int, ...], int], *keys: str) -> Column:
    """A literal look-up of bounded counts."""
    entries = [x for k, v in sorted(counts.items()) for x in (F.lit(",".join(map(str, k))), F.lit(v).cast("long"))]
    if not entries:
        return F.lit(0).cast("long")
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.concat_ws(",", *keys)), F.lit(0).cast("long"))


def _counts(df: DataFrame, *keys: str) -> dict[tuple[int, ...], int]:
    """Rows per combination of shards: at most shards squared."""
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*keys).agg(F.count(F.lit(1))).collect()}


def _round(rows: DataFrame, buckets: int) -> tuple[DataFrame | None, int]:
    """Moves of one round: ``row, to``, written; and their number."""
    free = _counts(rows.filter("NOT linked"), "shard")
    held = rows.filter("linked").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "weight", F.struct("n", F.xxhash64("group", "shard").alias("tie")))
    crowd = held.groupBy("shard").agg(F.sum("n")).collect()
    room = [s for s in {r.shard for r in crowd} | {k[0] for k in free}]
    open_to = held.filter((_table(free, "shard") > 0) | F.lit(not free)).filter(F.col("shard").isin(room))
    best = open_to.groupBy("group").agg(F.max(F.struct("weight", "shard")).alias("best"))
    leaving = held.join(best, "group").filter(F.col("weight") < F.col("best.weight")).select("group", "shard", F.col("best.shard").alias("to"))
    leaving = materialize(leaving, "leaving")
    movers = materialize(rows.filter("linked").join(leaving, ["group", "shard"]).select("row", "shard", "to"), "movers")
    asked = _counts(movers, "shard", "to")
    if not asked:
        return None, 0
    swapped = {k: min(v, asked.get((k[1], k[0]), 0)) for k, v in asked.items()}
    dealt = _ranked(movers, ["shard", "to"], buckets, "k").withColumn("even", F.col("k") < _table(swapped, "shard", "to"))
    dealt = materialize(dealt, "dealt")
    rest = _ranked(dealt.filter("NOT even").select("row", "shard", "to"), ["to"], buckets, "k")
    wanted: dict[tuple[int, ...], int] = {}
    for (s, t), n in asked.items():
        wanted[t,] = wanted.get((t,), 0) + n - swapped[s, t]
    free_rows = rows.filter("NOT linked").select(F.col("row"), F.col("shard").alias("to"))
    spare = _ranked(free_rows, ["to"], buckets, "k", upto=_table(wanted, "to")).withColumnRenamed("row", "spare")
    pairs = rest.join(spare, ["to", "k"]).select(F.explode(F.array(
        F.struct("row", F.col("to").alias("to")), F.struct(F.col("spare").alias("row"), F.col("shard").alias("to")))).alias("m"))
    moves = materialize(dealt.filter("even").select("row", "to").union(pairs.select("m.row", "m.to")), "moves")
    return moves, moves.count()


def assign_shards(df: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row (runs jobs).

    ``slot`` numbers the rows of a shard from 0; ``law`` is ``rows``; ``grown_shard`` is null under this law.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                     (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                     F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("group"))
    rows = materialize(rows, "rows")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    groups = rows.filter("group IS NOT NULL").groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", F.lit(True).alias("linked"))
    groups = materialize(groups, "groups")
    placed = _ranked(rows.withColumn("all", F.lit(0)), ["all"], max(buckets, 1) * shards, "rank").drop("all")
    placed = materialize(placed.join(groups, "group", "left").select(
        "row", "doc_id", "size", "text_crc32", "group", F.coalesce("linked", F.lit(False)).alias("linked"),
        (F.col("rank") % shards).cast("int").alias("shard")), "shards")
    while True:
        moves, n = _round(placed, buckets)
        if not n:
            break
        placed = materialize(placed.join(moves, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "shards")
    return _ranked(placed, ["shard"], buckets, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
