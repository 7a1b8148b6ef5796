"""Sets with a Jaccard similarity of ``similarity`` or more: MinHash bands, exact verification, connected parts.

Candidates. A set has ``BANDS`` keys, each of ``ROWS`` minima of its own random order of the hashes. Two sets of
similarity J share a key with probability 1 - (1 - J^ROWS)^BANDS: 0.9996 at J = 0.8 and more above it. This is the
only step that can miss a pair; no distance or count cuts after it.

Verification. A link is given only where the sizes of the intersection and the union, taken from the whole sets, say
so. Sets are 64-bit hashes of their members.

Bound. The hashes of a set are counted in ``STRATA`` strata. Two sets have no more in common than the sum of the
smaller counts, so a pair whose sum is too small is below the similarity and its sets are never read.

Scale. Equal sets are one node from the start. Pairs are never listed: of each key every node is compared with the
key's smallest one only, and nodes linked by that share a label. Keys whose nodes bear one label are done. In the others
blocks of nodes (``RUN`` nodes, ``HELD`` hashes at most, about) meet pair by pair, first by strata, then, for the nodes that
can be like one of another label, by their whole sets; of a pair of blocks only links that span what is connected
leave the task. So a hot key is split, no task holds it, and no pair that shares a key is left out.

Cases. The empty set shares no key and is like no other (equal sets are one node, so the callers of empty texts
share a node all the same). Null band lists have no keys. An empty table gives an empty one.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm.components import connected_components
from gaitframe.llm.textvec import mix
from gaitframe.session import materialize

BANDS = 20
ROWS = 5
STRATA = 128
RUN = 2048
HELD = 1 << 20
_MOST = np.iinfo(np.uint16).max
_BLOCK = 4096
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_TIMES, _PLUS = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def digest(held: np.ndarray) -> int:
    """Name of a set (sorted distinct hashes) as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), 7)).astype(np.int64))


def bands(held: np.ndarray) -> list[int]:
    """Band keys of a set; none for the empty set, which is like no other."""
    if not len(held):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), _BLOCK):
        least = np.minimum(least, (held[i:i + _BLOCK, None] * _TIMES + _PLUS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x100000001B3) + column)
    return key.view(np.int64).tolist()


def strata(held: np.ndarray) -> bytes:
    """Counts of a set's hashes by their highest bits; a set too large for them bounds nothing but by its size."""
    counts = np.bincount((held >> np.uint64(57)).astype(np.int64), minlength=STRATA)
    return (counts if counts.max(initial=0) < _MOST else np.full(STRATA, _MOST)).astype("<u2").tobytes()


def _enough(common: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    # The last term keeps a ratio that is exactly the limit on the right side of rounding.
    return common >= similarity * (sizes - common) - 1e-9


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, STRATA).astype(np.int32)


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs ``a, b`` that are as similar by the whole sets (a written table)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = materialize(sets_of(ends), "sets")
    one = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    both = one.join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                x, y = (batch.column(c)[i].values.to_numpy() for c in "xy")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = _enough(shared, len(x) + len(y), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return materialize(both.select("a", "b", "x", "y").mapInArrow(common, "a long, b long"), "verified")


def _with_first(met: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: every node with the smallest one of each of its keys, as far as the bound allows (a written table)."""
    sketch = nodes.select("node", "n", "strata")
    pairs = met.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    both = pairs.join(sketch.toDF("a", "n_a", "s_a"), "a").join(sketch.toDF("b", "n_b", "s_b"), "b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = np.minimum(_counts(batch.column("s_a")), _counts(batch.column("s_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(_enough(most, sizes, similarity)))

    return materialize(both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bounded, "a long, b long"), "pairs")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``group``, one batch per group."""
    held, last = [], None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        group = batch.column("group").to_numpy()
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)]).tolist()
        for a, b in zip(cut, [*cut[1:], len(group)], strict=True):
            if held and group[a] != last:
                yield whole()
                held.clear()
            held.append(batch.slice(a, b - a))
            last = group[a]
    if held:
        yield whole()


def _meet(batch: pa.RecordBatch, rows: slice, others: slice) -> np.ndarray:
    """Pairs that count: other labels, and other blocks where the group is of two blocks."""
    label, block = batch.column("label").to_numpy(), batch.column("block").to_numpy()
    two = block.min() != block.max()
    return (label[rows, None] != label[None, others]) & (~two | (block[rows, None] != block[None, others]))


def _open(similarity: float):
    """Of each group the nodes that can be like one of another label, by strata."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            n, counts = batch.column("n").to_numpy(), _counts(batch.column("strata"))
            order = np.argsort(n, kind="stable")
            batch, n, counts = batch.take(pa.array(order)), n[order], counts[order]
            wanted = np.zeros(len(n), dtype=bool)
            for i in range(0, len(n), 32):
                stop = int(np.searchsorted(n, n[min(i + 31, len(n) - 1)] / similarity + 1, side="right"))
                rows, others = slice(i, min(i + 32, len(n))), slice(i, stop)
                ok = _meet(batch, rows, others)
                if ok.any():
                    most = np.minimum(counts[rows, None], counts[None, others]).sum(axis=2)
                    ok &= _enough(most, n[rows, None] + n[None, others], similarity)
                    wanted[rows] |= ok.any(axis=1)
                    wanted[others] |= ok.any(axis=0)
            yield batch.select(["group", "node", "label", "block"]).filter(pa.array(wanted))

    return over


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two of some sets, as a product of their incidence matrices by column blocks."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often[column] > 1)
    column = (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[shared][order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, RUN):
        a, b = np.searchsorted(column, [c, c + RUN])
        held = np.zeros((len(sets), RUN), np.float32)
        held[owner[a:b], column[a:b] - c] = 1
        out += held @ held.T
    return out


def _linked(similarity: float):
    """``a, b``: links of labels that span what is connected in a group, by the whole sets."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            sets = [x.values.to_numpy() for x in batch.column("held")]
            size, every = np.array([len(s) for s in sets]), slice(0, len(sets))
            ok = _enough(common_counts(sets).astype(np.float64), size[:, None] + size[None, :], similarity) & _meet(batch, every, every)
            i, j = np.nonzero(np.triu(ok, 1))
            names, place = np.unique(batch.column("label").to_numpy(), return_inverse=True)
            root, i, j = np.arange(len(names)), place[i], place[j]
            while len(i):
                least = root.copy()
                np.minimum.at(least, i, root[j])
                np.minimum.at(least, j, root[i])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            moved = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], ["a", "b"])

    return over


def similar_parts(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``node, component`` of the nodes that share a key with another: nodes connected by pairs that share a key and are as similar.

    ``nodes`` is a written table of ``node, n`` (size), ``strata, bands``; ``sets_of`` gives ``node, held`` (sorted
    distinct hashes as longs) for a table of ``node``. Runs jobs.
    """
    entries = nodes.select("node", F.explode("bands").alias("key"))
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first")).filter("m > 1")
    met = materialize(entries.join(materialize(several.select("key", "first"), "shared-keys"), "key"), "met")
    links = _verified(_with_first(met, nodes, similarity), sets_of, similarity)
    label = materialize(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "labels")
    for _ in range(2):
        above = label.select(F.col("node").alias("label"), F.col("label").alias("above"))
        label = materialize(label.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
    labelled = met.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = materialize(labelled.join(nodes.select("node", "n"), "node"), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashes"))
    mixed = materialize(mixed.filter("low != high").select("key", F.greatest(F.ceil(F.col("m") / RUN), F.ceil(F.col("hashes") / HELD)).cast("int").alias("blocks")), "mixed")
    cut = labelled.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    rows = cut.select(group.alias("group"), "node", "label", "block", "n").join(nodes.select("node", "strata"), "node")
    rows = rows.select("group", "node", "label", "block", "n", "strata").repartition("group").sortWithinPartitions("group")
    left = materialize(rows.mapInArrow(_open(similarity), "group long, node long, label long, block int"), "open")
    held = materialize(sets_of(left.select("node").distinct()), "sets")
    whole = left.join(held, "node").select("group", "label", "block", "held").repartition("group").sortWithinPartitions("group")
    parts = connected_components(whole.mapInArrow(_linked(similarity), "a long, b long"))
    named = labelled.select("node", "label").distinct().join(parts.withColumnRenamed("node", "label"), "label", "left")
    return named.select("node", F.coalesce("component", "label").alias("component"))
