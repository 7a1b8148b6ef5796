"""Hard negatives by cover trees: rows of another label whose inner product with an anchor is near that of a positive.

Method. Components become integers (``floor(scale * x)``), so scores are exact. Candidates are sorted by length, label and
nearest pivot and cut into runs of one label; each run is a cover tree. A candidate is augmented by one component that
makes all of a run equally long (``sqrt(M^2 - |x|^2)``), which leaves inner products with an anchor as they are and
puts the run on a sphere. A node's centre is one of its rows; the next level's centres are taken farthest first until
the covering radius is halved or ``FAN`` of them are chosen; every node keeps its own covering radius, as an angle. The
angle between anchor and centre, plus or minus that radius, bounds all inner products below the node from both sides.
An anchor searches windows of scores, level by level: nodes whose bounds lie outside every window, or below what the
last of the best ``keep`` has, are skipped with all below them (the centres' own scores already count). The leaves
left are visited best bound first, every row in them is scored exactly, and the search ends when no bound can enter.
Positives are one window without limits over the trees of the anchor's label; negatives are one window for every positive
over the trees of other labels.

Scale. Anchors are a stated query set and meet all rows in groups of trees: a task holds one group (``GROUP`` rows at most,
about; components in the smallest integer type) and streams the anchors. No pair leaves a task but the best
``keep`` of each group; a window function that keeps ``keep`` rows before it shuffles ranks them. Groups are ranges
that end with the id, so one label or one vector may hold any part of the rows. The pivots are a bounded sample
(``PIVOTS`` rows); they only order the rows, every row is indexed and results do not depend on them.

Cases. Rows with a null id, label or vector, or with a null or non-finite component, take no part. An anchor never meets
rows of its own id, and vectors of another length than its own never meet it; empty vectors score zero. Rows that repeat
an id are rows of their own, as anchors and as candidates. Equal scores are ordered by id. Scores are exact below 2^63.
Other columns are ignored; an empty table gives an empty one.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.session import materialize

RUN = 4096
GROUP = 1 << 18
LEAF = 64
FAN = 8
PIVOTS = 64
CHUNK = 256
_EXACT = 2.0 ** 53


class Tree(NamedTuple):
    """A cover tree: rows in the order of the leaves; of each node its level, parent, rows, centre and angle."""

    label: int
    ids: np.ndarray
    rows: np.ndarray
    longest: float
    nodes: np.ndarray
    angle: np.ndarray


_LEVEL, _PARENT, _FROM, _TO, _CENTRE, _LEAF = range(6)


def cover_tree(label: int, ids: np.ndarray, x: np.ndarray) -> Tree:
    """``x`` are integer rows. The first row is the root's centre."""
    points = x.astype(np.float64)
    squares = np.einsum("ij,ij->i", points, points)
    longest = float(np.sqrt(squares.max(initial=0.0)))
    points = np.concatenate([points, np.sqrt(np.maximum(longest ** 2 - squares, 0.0))[:, None]], axis=1)

    def apart(rows: np.ndarray, centre: int) -> np.ndarray:
        d = points[rows] - points[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    every = np.arange(len(x))
    nodes, angle, order, ahead = [], [], [], [(0, -1, every, 0, apart(every, 0))]
    while ahead:
        level, parent, rows, centre, far = ahead.pop()
        radius, number = float(far.max()), len(nodes)
        leaf = len(rows) <= LEAF or radius == 0.0
        nodes.append([level, parent, sum(map(len, order)), 0, centre, leaf])
        angle.append(2 * np.arcsin(min(1.0, radius / (2 * longest))) if longest else 0.0)
        if leaf:
            order.append(rows)
            continue
        owner, least, centres = np.zeros(len(rows), np.int64), far, [centre]
        while len(centres) < FAN and least.max() > radius / 2:
            centres.append(int(rows[least.argmax()]))
            d = apart(rows, centres[-1])
            nearer = d < least
            owner[nearer], least = len(centres) - 1, np.where(nearer, d, least)
        for k, c in enumerate(centres):
            mine = owner == k
            ahead.append((level + 1, number, rows[mine], c, least[mine]))
    table = np.array(nodes, np.int64)
    order = np.concatenate(order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table[:, _CENTRE] = place[table[:, _CENTRE]]
    # Depth first: the rows below a node follow each other, a leaf's up to the next leaf's first.
    starts = np.append(table[table[:, _LEAF] == 1, _FROM], len(x))
    table[table[:, _LEAF] == 1, _TO] = starts[1:]
    return Tree(label, ids[order], x[order], longest, table, np.array(angle))


class Best:
    """Of every (anchor, window) the ``keep`` best rows so far, and the score below which no row enters."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, keep: int):
        self.need, self.hi, self.keep = lo.copy(), hi, keep
        self.at = [np.zeros((0, 3), np.int64)] * lo.shape[1]

    def wanted(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """(anchor, node) pairs of which some window is still open."""
        out = np.zeros(most.shape, dtype=bool)
        for w in range(len(self.at)):
            out |= (most >= self.need[:, w, None]) & (least <= self.hi[:, w, None])
        return out

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(len(self.at)):
            ok = (score >= self.need[anchor, w]) & (score <= self.hi[anchor, w])
            rows = np.concatenate([self.at[w], np.stack([anchor[ok], score[ok], ids[ok]], axis=1)])
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
            first = np.searchsorted(rows[:, 0], rows[:, 0])
            nth = np.arange(len(rows)) - first
            last = rows[nth == self.keep - 1]
            self.need[last[:, 0], w] = last[:, 1]
            self.at[w] = rows[nth < self.keep]

    def pass_by(self, seen: np.ndarray, w: int) -> None:
        """Scores of distinct rows (-inf where they don't count) raise what is needed, before the rows are visited."""
        if seen.shape[1] >= self.keep:
            last = np.partition(seen, -self.keep, axis=1)[:, -self.keep]
            enough = np.flatnonzero(last > -np.inf)
            self.need[enough, w] = np.maximum(self.need[enough, w], last[enough].astype(np.int64))


class Anchors(NamedTuple):
    key: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def search(trees: list[Tree], a: Anchors, keep: int, same: bool) -> Best:
    """The best rows of every window, from trees of the anchor's own label or of the others."""
    q, best = a.x.astype(np.float64), Best(a.lo, a.hi, keep)
    size = np.sqrt(np.einsum("ij,ij->i", q, q))
    most, least, leaves = [], [], []
    for t, tree in enumerate(trees):
        mine = ((tree.label == a.label) == same) & (a.lo <= a.hi).any(axis=1)
        if tree.rows.shape[1] != q.shape[1] or not mine.any():
            continue
        span = size * tree.longest
        alive, seen = np.zeros((len(q), len(tree.nodes)), dtype=bool), np.full((len(q), 0), -np.inf)
        for level in range(int(tree.nodes[:, _LEVEL].max()) + 1):
            here = np.flatnonzero(tree.nodes[:, _LEVEL] == level)
            above = alive[:, tree.nodes[here, _PARENT]] if level else mine[:, None]
            here, above = (here[some := above.any(axis=0)], above[:, some]) if level else (here, above)
            if not len(here):
                break
            centre = tree.nodes[here, _CENTRE]
            score = q @ tree.rows[centre].astype(np.float64).T
            turn = np.arccos(np.clip(score / np.maximum(span, 1e-300)[:, None], -1, 1))
            slack = 1e-7 * span[:, None] + 1e-6
            up = span[:, None] * np.cos(np.maximum(turn - tree.angle[here], 0)) + slack
            down = span[:, None] * np.cos(np.minimum(turn + tree.angle[here], np.pi)) - slack
            # A centre that is its parent's centre was counted there.
            new = np.ones(len(here), dtype=bool) if not level else centre != tree.nodes[tree.nodes[here, _PARENT], _CENTRE]
            counts = np.where(above[:, new] & (tree.ids[centre[new]] != a.ids[:, None]), score[:, new], -np.inf)
            seen = np.concatenate([seen, counts], axis=1)
            if (span < _EXACT).all():
                for w in range(a.lo.shape[1]):
                    best.pass_by(np.where((seen >= a.lo[:, w, None]) & (seen <= a.hi[:, w, None]), seen, -np.inf), w)
            alive[:, here] = above & best.wanted(down, up)
            ends = tree.nodes[here, _LEAF] == 1
            most.append(np.where(alive[:, here[ends]], up[:, ends], -np.inf))
            least.append(np.where(alive[:, here[ends]], down[:, ends], np.inf))
            leaves += [(t, *tree.nodes[n, [_FROM, _TO]].tolist()) for n in here[ends]]
    if not leaves:
        return best
    most, least, width = np.concatenate(most, axis=1), np.concatenate(least, axis=1), 1
    while True:
        open_ = best.wanted(least, most) & (most > -np.inf)
        if not open_.any():
            return best
        first = np.where(open_, most, -np.inf)
        if width < first.shape[1]:
            nth = np.partition(first, -width, axis=1)[:, -width, None]
            now = open_ & (first >= nth)
        else:
            now = open_
        parts = []
        for n in np.flatnonzero(now.any(axis=0)):
            t, start, stop = leaves[n]
            tree, who = trees[t], np.flatnonzero(now[:, n])
            score = _products(a.x[who], q[who], size[who], tree, start, stop)
            ids = tree.ids[start:stop]
            ok = np.zeros(score.shape, dtype=bool)
            for w in range(a.lo.shape[1]):
                ok |= (score >= best.need[who, w, None]) & (score <= best.hi[who, w, None])
            i, j = np.nonzero(ok & (ids != a.ids[who, None]))
            parts.append((who[i], score[i, j], ids[j]))
        best.add(*(np.concatenate([p[c] for p in parts]) for c in range(3)))
        most[now], width = -np.inf, width * 4


def _products(x: np.ndarray, q: np.ndarray, size: np.ndarray, tree: Tree, start: int, stop: int) -> np.ndarray:
    """Exact integer inner products: in doubles where none can pass 2^53."""
    rows = tree.rows[start:stop]
    if (size * tree.longest < _EXACT).all():
        return (q @ rows.astype(np.float64).T).astype(np.int64)
    return x @ rows.astype(np.int64).T


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """Integers in the smallest type that holds them all, and its number of bytes."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return x.astype(f"<i{width}").tobytes(), width


_TREE = "label long, dim int, width int, longest double, ids binary, rows binary, nodes binary, angle binary"


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per tree: runs of one length and label of at most ``RUN`` rows; the group is the partition."""
    group, held = TaskContext.get().partitionId(), []

    def row(rows: pa.RecordBatch) -> pa.RecordBatch:
        dim = rows.column("dim")[0].as_py()
        x = rows.column("x").flatten().to_numpy().reshape(len(rows), dim)
        tree = cover_tree(rows.column("label")[0].as_py(), rows.column("id").to_numpy(), x)
        packed, width = _packed(tree.rows)
        return pa.RecordBatch.from_pylist([{
            "group": group, "label": tree.label, "dim": dim, "width": width, "longest": tree.longest, "ids": tree.ids.tobytes(),
            "rows": packed, "nodes": tree.nodes.tobytes(), "angle": tree.angle.tobytes()}], schema=pa.schema([
                ("group", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()), ("width", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()),
                ("rows", pa.binary()), ("nodes", pa.binary()), ("angle", pa.binary())]))

    def whole(last: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        kinds = np.stack([rows.column("dim").to_numpy().astype(np.int64), rows.column("label").to_numpy()], axis=1)
        cut = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]).any(axis=1), [True]])).tolist()
        held.clear()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            stop = b if last or b < len(rows) else a + (b - a) // RUN * RUN
            for i in range(a, stop, RUN):
                yield row(rows.slice(i, min(RUN, stop - i)))
            if stop < b:
                held.append(rows.slice(stop))

    for batch in batches:
        if len(batch):
            held.append(batch)
            if sum(map(len, held)) >= 2 * RUN:
                yield from whole(False)
    yield from whole(True)


def _seek(keep: int, same: bool):
    """mapInArrow over rows sorted by group and kind: a group's trees, then the anchors with their windows."""

    def tree(r: dict) -> Tree:
        rows = np.frombuffer(r["rows"], f"<i{r['width']}").reshape(len(r["ids"]) // 8, r["dim"])
        return Tree(r["label"], np.frombuffer(r["ids"], np.int64), rows, r["longest"], np.frombuffer(r["nodes"], np.int64).reshape(-1, 6),
                    np.frombuffer(r["angle"], np.float64))

    def rows_of(trees: list[Tree], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(batch), CHUNK):
            part = batch.slice(i, CHUNK)
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = part.take(pa.array(np.flatnonzero(dims == dim)))
                n = len(some)

                def numbers(c: str, some=some, n=n) -> np.ndarray:
                    return some.column(c).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0))

                x = some.column("x").flatten().to_numpy().reshape(n, dim)
                a = Anchors(some.column("key").to_numpy(), some.column("id").to_numpy(), some.column("label").to_numpy(), x, numbers("lo"), numbers("hi"))
                for w, found in enumerate(search(trees, a, keep, same).at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.key[found[:, 0]]), pa.array(np.full(len(found), w, np.int32)), pa.array(found[:, 2]), pa.array(found[:, 1])],
                        ["key", "window", "id", "score"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees = None, []
        for batch in batches:
            keys = np.stack([batch.column("group").to_numpy(), batch.column("kind").to_numpy()], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])).tolist() if len(keys) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if keys[a, 0] != group:
                    group, trees = keys[a, 0], []
                if keys[a, 1] == 0:
                    trees += [tree(r) for r in batch.slice(a, b - a).select(["label", "dim", "width", "longest", "ids", "rows", "nodes", "angle"]).to_pylist()]
                elif trees:
                    yield from rows_of(trees, batch.slice(a, b - a))

    return over


def _met(trees: DataFrame, anchors: DataFrame, groups: int, keep: int, same: bool) -> DataFrame:
    """``key, window, rank, id, score``: the best rows of every anchor's windows over all groups."""
    fields = [f for f in _TREE.split(", ")]
    held = trees.select("group", F.lit(0).alias("kind"), *[f.split()[0] for f in fields],
                        *[F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("id", "long"), ("x", "array<long>"), ("lo", "array<long>"), ("hi", "array<long>"))])
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "*")
    if same:
        kinds = trees.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        asked = asked.join(kinds, "group").filter("label BETWEEN low AND high")
    asked = asked.select("group", F.lit(1).alias("kind"), "label", F.size("x").alias("dim"), *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields[2:]],
                         "key", "id", "x", "lo", "hi")
    met = held.union(asked).repartitionById(groups, "group").sortWithinPartitions("group", "kind")
    found = met.mapInArrow(_seek(keep, same), "key long, window int, id long, score long")
    place = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= keep)


def mine(df: DataFrame, anchor: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", scale: float = 256.0, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``anchor`` (a condition on ``df``) holds. The first ``positives`` other rows of an
    anchor's label are its positives; of each the first ``negatives`` rows of other labels with ``low * positive <= 100 *
    negative <= high * positive`` (scores) are returned. Runs jobs (the trees and the positives are written tables).
    """
    spark, x = df.sparkSession, F.col(vector).cast("array<double>")
    finite = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), anchor.alias("anchor"),
                     F.when(finite, F.transform(x, lambda e: F.floor(e * scale))).alias("x")).filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = materialize(rows.withColumn("dim", F.size("x")), "vectors")
    n = rows.count()
    groups = max(-(-n // GROUP), min(2 * spark.sparkContext.defaultParallelism, -(-n // RUN)), 1)
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("x").collect()
    points = [np.array(r.x, np.float64) for r in pivots]

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, nearest = batch.column("dim").to_numpy(), np.zeros(len(batch), np.int32)
            for dim in np.unique(dims):
                those = np.flatnonzero(dims == dim)
                centres = [p for p in points if len(p) == dim]
                if centres and dim:
                    x = batch.column("x").take(pa.array(those)).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                    c = np.stack(centres)
                    nearest[those] = (np.einsum("ij,ij->i", c, c) - 2 * x @ c.T).argmin(axis=1)
            yield batch.append_column("cell", pa.array(nearest))

    placed = rows.select("id", "label", "dim", "x").mapInArrow(cell, "id long, label long, dim int, x array<long>, cell int")
    order = ["dim", "label", "cell", "id"]
    trees = materialize(placed.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInArrow(_plant, f"group int, {_TREE}"), "cover-trees")
    groups = (trees.agg(F.max("group")).first()[0] or 0) + 1
    anchors = materialize(rows.filter("anchor").select("id", "label", "x").withColumn("key", F.monotonically_increasing_id()), "anchors")
    free = [F.array(F.lit(e).cast("long")).alias(c) for c, e in (("lo", -(1 << 63)), ("hi", (1 << 63) - 1))]
    liked = materialize(_met(trees, anchors.select("*", *free), groups, positives, True), "positives")
    # A window's scores: 100 * s lies between low * p and high * p; windows not in use are empty.
    by_place = liked.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("p"))

    def limit(per_cent: int, rounded, absent: int) -> Column:
        part = lambda i: rounded(F.col("p")[i].cast("decimal(24,0)") * F.lit(per_cent) / F.lit(100)).cast("long")
        return F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(part(i), F.lit(absent).cast("long")))

    windows = by_place.select("key", limit(low, F.ceil, 1).alias("lo"), limit(high, F.floor, 0).alias("hi"))
    unlike = _met(trees, anchors.join(windows, "key"), groups, negatives, False)
    found = unlike.select("key", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), (F.col("window") + 1).alias("place"))
    given = liked.select("key", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["key", "place"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
