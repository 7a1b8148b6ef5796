"""Embedding near duplicates: the epsilon grid order join over unit vectors.

Method. Cosine >= c is Euclidean distance <= eps = sqrt(2 - 2c) between unit vectors. Vectors are rotated to
their principal axes (a rotation keeps distances; the second moments are summed on the cluster, their matrix
is as large as the dimension), sorted by their grid cells of width eps on the leading axes and cut into runs
of ``BLOCK``. Runs have bounding boxes, and boxes of boxes form a tree. The join starts at the top and goes
down pair by pair: a pair of intervals farther apart than eps is skipped with all below it. What is left are
pairs of runs, multiplied as matrices; pairs near the limit are decided in double precision on the given
components.

Scale. Equal vectors are one row with a count. Runs are dealt by pairs of tiles (``TILE`` neighbouring runs and ``TILE_BYTES`` at
most, fewer where that leaves cores idle): a task holds the runs of two tiles and multiplies the pairs of runs that are left, so a
run is sent once per tile it meets and not once per run, and the work of a dense region is spread. Only link counts and
a spanning set of links leave the task, never the links. The tree and the pairs are tables.

Cases. Null, empty and zero vectors and vectors with null or non-finite components link with nothing: no links, own
component, kept. Vectors of different lengths never link; the vectors of each length are joined by themselves. Repeated ids are vectors of their own for counts;
the component is named by the smallest id. Null ids never name a component (a component of null ids is null).
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.llm.components import connected_components
from gaitframe.session import materialize

BLOCK = 2048
TILE = 64
TILE_BYTES = 64 << 20
FAN = 16
AXES = 8
_NEAR = 1e-4


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    rows = np.frombuffer(b"".join(column.to_pylist()), kind)
    return rows.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(df: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, str]:
    """``vec_id, id, v``: the packed components of every row, null where the vector can link with nothing; and their type."""
    single = df.schema[vector].dataType.elementType == T.FloatType()
    x = F.col(vector).cast("array<float>" if single else "array<double>")
    kind = "<f4" if single else "<f8"
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.when(finite, x).alias("x"))
    size = rows.filter("x IS NOT NULL").groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.select("vec_id", F.when(F.size("x") == (size.d if size else -1), F.col("x")).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
            rows = iter(flat.reshape(len(x) - x.null_count, -1) if len(flat) else ())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([next(rows).tobytes() if ok else None for ok in x.is_valid().to_pylist()], pa.binary())],
                                             ["vec_id", "v"])

    name = df.schema[vec_id].dataType.simpleString()
    return rows.mapInArrow(pack, f"vec_id {name}, v binary").withColumn("id", F.col("vec_id").cast("long")), kind


def _axes(vectors: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and principal axes (columns, leading first) of the unit vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch.column("v"), kind))
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "n"])

    sums = vectors.mapInArrow(moments, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    if not sums:
        return None
    flat = np.array([r.n for r in sorted(sums)])
    d = round((-1 + (4 * len(flat) - 3) ** 0.5) / 2)
    mean = flat[1:d + 1] / flat[0]
    _, axes = np.linalg.eigh(flat[d + 1:].reshape(d, d) / flat[0] - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def _boxes(df: DataFrame, child: str, fan: int) -> DataFrame:
    """The next level of the tree: boxes around ``fan`` neighbours."""
    return df.groupBy(F.floor(F.col(child) / fan).cast("long").alias("node")).agg(
        *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(AXES)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(AXES)])


def _apart(a: str, b: str) -> "F.Column":
    """Squared distance of two boxes."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}"), F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}")) for i in range(AXES)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _run_pairs(runs: DataFrame, n_runs: int, eps: float) -> DataFrame:
    """Pairs ``a <= b`` of runs whose boxes come within ``eps``, found from the top of the tree downwards."""
    levels = [runs.withColumnRenamed("run", "node")]
    while n_runs > FAN:
        levels.append(materialize(_boxes(levels[-1], "node", FAN), "boxes"))
        n_runs = -(-n_runs // FAN)
    top = levels[-1].select("node")
    pairs = top.select(F.col("node").alias("a"), F.explode(F.sequence(F.col("node"), F.lit(n_runs - 1).cast("long"))).alias("b"))
    limit = (eps + 1e-9) ** 2
    for below in reversed(levels):
        left, right = below.alias("l"), below.alias("r")
        met = pairs.join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node")).filter(_apart("l", "r") <= limit)
        pairs = met.select("a", "b")
        if below is not levels[0]:
            under = F.array(*[F.lit(i).cast("long") for i in range(FAN)])
            pairs = pairs.select(F.explode(F.transform(under, lambda i: F.col("a") * FAN + i)).alias("a"), "b")
            pairs = pairs.select("a", F.explode(F.transform(under, lambda i: F.col("b") * FAN + i)).alias("b")).filter("a <= b")
            pairs = materialize(pairs, "interval-pairs")
    return pairs


def similar_vectors(df: DataFrame, cosine: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row (runs jobs; ``cosine`` must be above 0)."""
    size = F.size(vector)
    lengths = sorted(r.n for r in df.filter(size > 0).select(size.alias("n")).distinct().collect())
    if len(lengths) < 2:
        return _of_one_length(df, cosine, vector, vec_id)
    parts = [df.filter(size == n) for n in lengths] + [df.filter(~F.coalesce(size > 0, F.lit(False)))]
    return reduce(DataFrame.union, [_of_one_length(part, cosine, vector, vec_id) for part in parts])


def _of_one_length(df: DataFrame, cosine: float, vector: str, vec_id: str) -> DataFrame:
    eps = float(np.sqrt(2 - 2 * cosine))
    packed, kind = _packed(df, vector, vec_id)
    distinct = packed.filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"))
    distinct = materialize(distinct.withColumn("key", F.monotonically_increasing_id()), "vectors")
    found = _axes(distinct, kind)
    if found is None:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    mean, axes = found
    lead = min(AXES, axes.shape[1])
    places = ", ".join(f"p{i} double" for i in range(AXES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = np.zeros((len(batch), AXES))
            p[:, :lead] = (_unit(_matrix(batch.column("v"), kind)) - mean) @ axes[:, :lead]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), batch.column("v"), *(pa.array(p[:, i]) for i in range(AXES))],
                                             ["key", "copies", "v", *(f"p{i}" for i in range(AXES))])

    placed = distinct.select("key", "copies", "v").mapInArrow(place, f"key long, copies long, v binary, {places}")
    cells = [F.floor(F.col(f"p{i}") / eps) for i in range(AXES)]
    ordered = placed.repartitionByRange(*cells, "key").sortWithinPartitions(*cells, *[f"p{i}" for i in range(AXES)], "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per run of the sequence: keys, copies, vectors and box."""
        held = []

        def row(rows):
            p = np.stack([rows.column(f"p{i}").to_numpy() for i in range(AXES)], axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows.column("key").to_numpy().tobytes()]), pa.array([rows.column("copies").to_numpy().tobytes()]), pa.array([b"".join(rows.column("v").to_pylist())]),
                 *(pa.array([x]) for x in p.min(axis=0)), *(pa.array([x]) for x in p.max(axis=0))],
                ["keys", "copies", "vectors", *(f"lo{i}" for i in range(AXES)), *(f"hi{i}" for i in range(AXES))])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                for i in range(0, len(rows) - BLOCK + 1, BLOCK):
                    yield row(rows.slice(i, BLOCK))
                held = [rows.slice(len(rows) - len(rows) % BLOCK)]
        if sum(map(len, held)):
            yield row(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    boxes = ", ".join(f"{s}{i} double" for s in ("lo", "hi") for i in range(AXES))
    runs = materialize(ordered.mapInArrow(cut, f"keys binary, copies binary, vectors binary, {boxes}").withColumn("at", F.monotonically_increasing_id()), "runs")
    runs = _numbered(runs)
    n_runs = runs.count()
    pairs = _run_pairs(runs.select("run", *[f"{s}{i}" for s in ("lo", "hi") for i in range(AXES)]), n_runs, eps)
    counted = materialize(_tiles(pairs, runs, n_runs, axes.shape[0]).mapInArrow(_links_of_tiles(cosine, kind), "key long, n long, other long"), "links")
    degree = counted.filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(counted.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = distinct.join(parts, distinct["key"] == parts["node"], "left").select("v", "key", "id", "copies", F.coalesce("component", "key").alias("component"))
    first = materialize(named.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    known = named.join(first, "component").join(degree, "key", "left").select(
        "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return packed.join(known, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), ids.alias("component_id"),
        F.coalesce(F.col("id") == ids, F.lit(False)).alias("kept"))


def _numbered(runs: DataFrame) -> DataFrame:
    """``run``: the place of each run in the sequence, from counts per partition."""
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    sizes = {r.p: r.n for r in runs.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += sizes[p]
    start = F.element_at(F.create_map(*starts), part.cast("long")) if starts else F.lit(0).cast("long")
    return runs.withColumn("run", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def _tiles(pairs: DataFrame, runs: DataFrame, n_runs: int, dim: int) -> DataFrame:
    """Rows by pair of tiles: the runs that it needs (kind 0), then its pairs of runs (kind 1)."""
    cores = runs.sparkSession.sparkContext.defaultParallelism
    tile = max(1, min(TILE, TILE_BYTES // (BLOCK * dim * 8), int(n_runs / (4 * cores) ** 0.5)))
    tiled = materialize(pairs.select("a", "b", F.floor(F.col("a") / tile).alias("ta"), F.floor(F.col("b") / tile).alias("tb")), "run-pairs")
    needed = tiled.select("ta", "tb", F.explode(F.array("a", "b")).alias("run")).distinct()
    held = needed.join(runs.select("run", "keys", "copies", "vectors"), "run").select(
        "ta", "tb", F.lit(0).alias("kind"), F.col("run").alias("a"), F.col("run").alias("b"), "keys", "copies", "vectors")
    none = [F.lit(None).cast("binary").alias(c) for c in ("keys", "copies", "vectors")]
    met = held.union(tiled.select("ta", "tb", F.lit(1).alias("kind"), "a", "b", *none))
    return met.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "kind", "a", "b")


def _links_of_tiles(cosine: float, kind: str):
    def run(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, copies = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("keys", "copies"))
        return keys, copies, _unit(np.frombuffer(batch.column("vectors")[r].as_py(), kind).reshape(len(keys), -1).astype(np.float64))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held = None, {}
        for batch in batches:
            for r, (ta, tb, what, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ta", "tb", "kind", "a", "b")), strict=True)):
                if (ta, tb) != tiles:
                    tiles, held = (ta, tb), {}
                if what == 0:
                    held[a] = run(batch, r)
                else:
                    yield _links_of_pair(held[a], held[b], a == b, cosine)

    return over


def _links_of_pair(a: tuple, b: tuple, same: bool, cosine: float) -> pa.RecordBatch:
    """Link counts (copies of the linked vectors) and spanning links of one pair of runs (keys, copies, unit vectors)."""
    keys, copies, units = zip(a, b, strict=True)
    rough = units[0].astype(np.float32) @ units[1].astype(np.float32).T
    i, j = np.nonzero(rough >= cosine - _NEAR)
    ok = rough[i, j] > cosine + _NEAR
    close = np.flatnonzero(~ok)
    ok[close] = np.einsum("ij,ij->i", units[0][i[close]], units[1][j[close]]) >= cosine
    if same:
        ok &= i < j
    i, j = i[ok], j[ok]
    key, copy, shift = (keys[0], copies[0], 0) if same else (np.concatenate(keys), np.concatenate(copies), len(keys[0]))
    a, b = np.concatenate([i, j + shift]), np.concatenate([j + shift, i])
    weight = np.bincount(a, weights=copy[b], minlength=len(key)).astype(np.int64)
    label = np.arange(len(key))
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(weight)
    root = label[some] == some
    return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(weight[some]), pa.array(key[label[some]], mask=root)], ["key", "n", "other"])
