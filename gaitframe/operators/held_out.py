"""Leave-one-out trees: the prediction for every row by a decision tree fitted on all rows but those of its own fold.

Trees of most folds agree in most nodes, as taking the few rows of a fold away seldom changes the best split. So a node is
known by the splits above it and stands for all folds whose trees have it: its histogram is added up once, and every fold
subtracts its own rows and takes its own best split. Folds that choose another split go on in nodes of their own. Only nodes in
which a fold has rows to predict are followed. Taking ``k`` rows away changes the score of a split (sum of squared class
counts over the rows of a side) by at most ``k``, so only splits within ``2 * k`` of the best are scored again; this is exact.

Rules are those of Spark ML's tree: Gini, 32 bins, one row in a leaf at least, the first of equal splits, the first of equal
classes. Limits of bins are quantiles of at most ``forest.SAMPLE`` rows, drawn for folds of even number from those of odd
number and the other way round, so a fold's own rows never take part, not even in its bins.

Scale. Nodes of more than ``ROWS`` rows are passes over the table: tasks add up histograms, folds meet them by shares, rows are
joined with the splits chosen. Below, the rows of a node meet in one group and are finished there. A pass costs the rows times
the different splits of a node; where every fold chose splits of its own the job would be quadratic in the folds.

Cases. Rows without a fold train every tree and are not predicted. A missing label or nothing to fit on is an error; no rows
give no predictions. Missing values are not compared: callers replace them.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.operators.forest import BINS, BLOCK, limits
from gaitframe.session import materialize

#: Rows of a node that are finished in one group, and rows of folds that meet a histogram in one share.
ROWS = 16_384
#: Histograms a task holds before it hands them on.
OPEN = 64

_PREDICTED = "fold int, subject_id string, y int, predicted int"
_CHOICES = "node long, fold int, feature int, cut binary, predicted int"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), d)


def histogram(bins: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Rows by (feature, bin, class)."""
    d, out = bins.shape[1], 0
    for i in range(0, len(y), BLOCK):
        place = (np.arange(d) * BINS + bins[i:i + BLOCK]) * classes + y[i:i + BLOCK, None]
        out = out + np.bincount(place.ravel(), minlength=d * BINS * classes)
    return np.reshape(out, (d, BINS, classes)) if len(y) else np.zeros((d, BINS, classes), np.int64)


def _score(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.zeros(left.shape[:-1])
    for side in (left, total - left):
        n = side.sum(-1)
        out += np.divide((side * side).sum(-1), n, out=np.zeros(n.shape), where=n > 0)
    return out


class Node:
    """What the folds of a node share: counts left of every split, and the scores."""

    def __init__(self, h: np.ndarray):
        self.classes = h.shape[-1]
        self.total = h[0].sum(axis=0).astype(float)
        self.left = h.cumsum(axis=1)[:, :-1].reshape(-1, self.classes).astype(float)
        self.score = _score(self.left, self.total)
        self.order = np.argsort(-self.score, kind="stable")
        self.sorted = self.score[self.order]
        self.best = int(self.order[0])
        whole = (self.total ** 2).sum() / max(self.total.sum(), 1.0)
        #: A fold with at most this many rows takes the node's best split.
        self.safe = (min(self.sorted[0] - self.sorted[1], self.sorted[0] - whole * (1 + 1e-9)) - 1e-6) / 2

    def choose(self, bins: np.ndarray, y: np.ndarray, more: np.ndarray | None = None) -> int | None:
        """The split of a fold with these rows (and those of the histogram ``more``), None for a leaf."""
        if more is None and len(y) <= self.safe:
            return self.best
        if more is None:
            near = np.sort(self.order[:np.searchsorted(-self.sorted, 2 * len(y) + 1e-6 - self.sorted[0], side="right")])
            feature, cut = near // (BINS - 1), near % (BINS - 1)
            own = np.zeros((len(near), self.classes))
            for i in range(0, len(y), 1024):
                own += (bins[i:i + 1024, feature] <= cut).T.astype(float) @ np.eye(self.classes)[y[i:i + 1024]]
            total = self.total - np.bincount(y, minlength=self.classes)
        else:
            h = more + histogram(bins, y, self.classes)
            near = np.arange(len(self.left))
            own, total = h.cumsum(axis=1)[:, :-1].reshape(-1, self.classes), self.total - h[0].sum(axis=0)
        score = _score(self.left[near] - own, total)
        at = int(score.argmax())
        whole = (total ** 2).sum() / max(total.sum(), 1.0)
        return int(near[at]) if score[at] > whole * (1 + 1e-9) else None


def finish(bins: np.ndarray, y: np.ndarray, fold: np.ndarray, own: np.ndarray, depth: int, classes: int) -> np.ndarray:
    """The class predicted for the rows numbered ``own`` by the trees below a node with all these rows."""
    out, open_nodes = np.full(len(y), -1), [(np.arange(len(y)), own[np.argsort(fold[own], kind="stable")], depth)]
    while open_nodes:
        rows, own, depth = open_nodes.pop()
        counts = np.bincount(y[rows], minlength=classes)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(fold[own]) != 0]))
        parts, chosen = np.split(own, starts[1:]), {}
        node = Node(histogram(bins[rows], y[rows], classes)) if depth and np.count_nonzero(counts) > 1 else None
        for part in parts:
            split = node.choose(bins[part], y[part]) if node else None
            if split is None:
                out[part] = (counts - np.bincount(y[part], minlength=classes)).argmax()
            else:
                chosen.setdefault(split, []).append(part)
        for split, some in chosen.items():
            feature, cut, mine = split // (BINS - 1), split % (BINS - 1), np.concatenate(some)
            for side in (True, False):
                below = mine[(bins[mine, feature] <= cut) == side]
                if len(below):
                    open_nodes.append((rows[(bins[rows, feature] <= cut) == side], below, depth - 1))
    return out


def _packed(rows: DataFrame, labels: list[str], cuts: dict[int, np.ndarray]) -> DataFrame:
    """Every row once per side, in the root of the side; ``own`` on the side of its fold."""
    y = (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int")
    plain = rows.select(F.coalesce("fold", F.lit(-1)).cast("int").alias("fold"), "subject_id", y.alias("y"), vector_to_array("features").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            fold = batch.column("fold").to_numpy()
            for side, limit in cuts.items():
                b = np.stack([np.searchsorted(c, v) for c, v in zip(limit, x.T)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fold), side)), *(batch.column(n) for n in ("fold", "subject_id", "y")), pa.array((fold >= 0) & (fold % 2 == side)),
                     pa.array([r.tobytes() for r in b], pa.binary())], ["node", "fold", "subject_id", "y", "own", "bins"])

    return plain.mapInArrow(pack, "node long, fold int, subject_id string, y int, own boolean, bins binary")


def _histograms(rows: DataFrame, d: int, classes: int) -> DataFrame:
    """``node, h`` of every node, added up in streams."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}

        def hand_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([h.tobytes() for h in held.values()], pa.binary())], ["node", "h"])
            held.clear()
            return made

        for batch in batches:
            node, y, bins = batch.column("node").to_numpy(), batch.column("y").to_numpy(), _matrix(batch.column("bins"), d)
            for n in np.unique(node):
                here = np.flatnonzero(node == n)
                held[int(n)] = held.get(int(n), 0) + histogram(bins[here], y[here], classes)
                if len(held) >= OPEN:
                    yield hand_on()
        if held:
            yield hand_on()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for n, h in zip(batch.column("node").to_pylist(), batch.column("h")):
                if n != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()])], ["node", "h"])
                total = np.frombuffer(h.as_py(), np.int64) + (total if n == at else 0)
                at = n
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()])], ["node", "h"])

    return rows.select("node", "y", "bins").mapInArrow(part, "node long, h binary").repartition("node").sortWithinPartitions("node").mapInArrow(
        add, "node long, h binary")


def _choices(at: DataFrame, sizes: DataFrame, d: int, classes: int, leaf: bool) -> DataFrame:
    """The split (feature -1: none) of every fold with own rows in a node, and the class a leaf would predict (a written table)."""
    shares = sizes.select("node", F.ceil(F.col("k") / ROWS).cast("int").alias("shares"))
    h = _histograms(at, d, classes).join(shares, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(-2).alias("fold"), F.lit(0).alias("y"), F.col("h").alias("bins"))
    own = at.filter("own").join(shares, "node").select("node", F.pmod(F.xxhash64("fold"), "shares").cast("int").alias("share"), "fold", "y", "bins")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, key, held, more = None, None, [], None
        made = []

        def close() -> None:
            nonlocal held, more
            if not held:
                return
            y, bins = (np.concatenate(v) for v in zip(*held))
            split = None if leaf else node.choose(bins, y, more)
            gone = np.bincount(y, minlength=classes) + (0 if more is None else more[0].sum(axis=0))
            feature, cut = (-1, b"\0") if split is None else (split // (BINS - 1), bytes([split % (BINS - 1)]))
            made.append((*key, feature, cut, int((node.total - gone).argmax())))
            held, more = [], None

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*made), kinds)], ["node", "fold", "feature", "cut", "predicted"])
            made.clear()
            return batch

        for batch in batches:
            nodes, folds, y = (batch.column(c).to_numpy() for c in ("node", "fold", "y"))
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(nodes) != 0) | (np.diff(folds) != 0), [True]])).tolist() if len(y) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if (nodes[a], folds[a]) != key:
                    close()
                    key = (int(nodes[a]), int(folds[a]))
                if folds[a] == -2:
                    node = Node(np.frombuffer(batch.column("bins")[a].as_py(), np.int64).reshape(d, BINS, classes))
                    continue
                held.append((y[a:b], _matrix(batch.column("bins").slice(a, b - a), d)))
                if sum(len(v) for v, _ in held) > ROWS:
                    for v, w in held:
                        more = histogram(w, v, classes) + (0 if more is None else more)
                    held = [(v[:0], w[:0]) for v, w in held[:1]]
            if made:
                yield out()
        close()
        if made:
            yield out()

    met = h.union(own).repartition("node", "share").sortWithinPartitions("node", "share", "fold")
    return materialize(met.mapInArrow(choose, _CHOICES), "choices")


def _below(depth: int, d: int, classes: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def below(key: tuple, table: pa.Table) -> pa.Table:
        y, fold, own = (table.column(c).to_numpy() for c in ("y", "fold", "own"))
        own = np.flatnonzero(own)
        made = finish(_matrix(table.column("bins"), d), y, fold, own, depth, classes)
        return table.select(["fold", "subject_id", "y"]).take(pa.array(own)).append_column("predicted", pa.array(made[own], pa.int32()))

    return below


def predictions(rows: DataFrame, depth: int) -> DataFrame:
    """``fold, subject_id, label, prediction`` of every row of ``rows`` with a ``fold`` (0, 1, ...), by the tree of that depth without
    the rows of its fold. ``rows`` is a written table with ``subject_id``, ``label`` and ``features`` (runs jobs)."""
    spark = rows.sparkSession
    labels = [r.label for r in rows.select("label").distinct().orderBy("label").collect()]
    if None in labels:
        raise ValueError("rows without a label")
    shape = rows.agg(F.max("fold").alias("last")).first()
    kind = "fold int, subject_id string, label string, prediction string"
    if shape.last is None:
        return spark.createDataFrame([], kind)
    d, classes = rows.select(F.size(vector_to_array("features")).alias("n")).first().n, len(labels)
    cuts = {}
    for side in (0, 1) if shape.last else (0,):
        others = rows.filter(F.col("fold").isNull() | (F.col("fold") % 2 != side)).select(F.col("features").alias("_scaled"))
        if others.isEmpty():
            raise ValueError("no rows to fit on")
        cuts[side] = limits(others, d)

    at, found = materialize(_packed(rows, labels, cuts), "held-out"), []
    for level in range(depth + 1):
        sizes = materialize(at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("k")).filter("k > 0"), "sizes")

        small = at.join(sizes.filter(F.col("n") <= ROWS).select("node"), "node")
        parts = 4 * spark.sparkContext.defaultParallelism
        found.append(materialize(small.repartition(parts, "node").groupBy("node").applyInArrow(_below(depth - level, d, classes), _PREDICTED), "predicted"))
        large = sizes.filter(F.col("n") > ROWS)
        if large.isEmpty():
            break
        rest = at.join(F.broadcast(large.select("node")), "node")
        choices = _choices(rest, large, d, classes, level == depth)
        found.append(materialize(rest.filter("own").join(choices.filter("feature < 0"), ["node", "fold"]).select("fold", "subject_id", "y", "predicted"), "predicted"))
        if level == depth:
            break
        splits = choices.filter("feature >= 0").select("node", "feature", "cut").distinct()
        mine = choices.filter("feature >= 0").select("node", "fold", "feature", "cut", F.lit(True).alias("_mine"))
        goes_left = F.expr("substring(bins, feature + 1, 1)") <= F.col("cut")
        at = materialize(rest.join(splits, "node").join(mine, ["node", "fold", "feature", "cut"], "left").select(
            F.xxhash64("node", "feature", "cut", goes_left).alias("node"), "fold", "subject_id", "y",
            (F.col("own") & F.coalesce("_mine", F.lit(False))).alias("own"), "bins"), "held-out")
    out = found[0]
    for some in found[1:]:
        out = out.unionByName(some)

    def name(place: str) -> Column:
        return F.element_at(F.array(*map(F.lit, labels)), F.col(place) + 1)

    return out.select("fold", "subject_id", name("y").alias("label"), name("predicted").alias("prediction"))
