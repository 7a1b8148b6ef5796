"""Random forests grown and walked in tasks, as a written table of subtrees.

Growing. Values are binned at quantiles of at most ``SAMPLE`` rows, as Spark ML does; every row takes part in every tree with a
Poisson weight, the digest of (seed, tree, row). Nodes with more than ``ROWS`` drawn rows are split from histograms that tasks
add up; only the chosen splits reach the driver. Once a node is small its rows meet in one group, in which the subtree below is
grown to its end. So a deep level costs no pass over the table, and what is shuffled is every row once per tree, a byte a value,
for as many trees at a time as ``SHUFFLED`` allows; the files of a portion are removed before the next.

Walking. Rows travel in blocks of a byte a value to groups of ``GROUP`` trees; a task holds the trees of one group, and the votes
of a block are added up afterwards. For permuted features a task holds all trees, as a row's votes are needed together: a row
walks every tree once, and again, from the node where the decision changes, only for features that change it.

Bounds. A group of rows holds ``ROWS`` drawn rows, a pass ``OPEN`` histograms; a tree of depth ``d`` has at most ``2 ** (d + 1)``
nodes whatever the number of rows. The driver holds the splits of nodes above ``ROWS`` rows.

Cases. Missing values are not compared: callers replace them, as for fitting. Features with one value are never split.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.session import materialize, scratch_path, shuffles_freed

SAMPLE, BINS = 10_000, 32
#: Drawn rows of a node below which its subtree is grown in one group.
ROWS = 65_536
#: Nodes whose histograms one pass adds up.
OPEN = 4_096
GROUP = 10
#: Rows that travel together, and rows of a task of walks.
BLOCK, SHARE = 8_192, 262_144
_PART_BYTES = 1 << 27
#: Bytes of rows, each once per tree, that are shuffled at a time.
SHUFFLED = 1 << 31
_NODES = 128
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])

TREES_SCHEMA = "tree int, node int, feature binary, cut binary, left binary, counts binary, gains array<double>"


class ForestModel(NamedTuple):
    """``path`` holds the table of subtrees (``node`` -1: the splits above them); ``cuts`` are the limits of the bins."""

    labels: list[str]
    class_weights: list[float]
    scale: StandardScalerModel
    cuts: np.ndarray
    trees: int
    depth: int
    path: str


class Trees(NamedTuple):
    """Nodes of some trees. The right child stands behind the left one; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray
    roots: np.ndarray
    depth: int


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def drawn(seed: int, tree: int, row: np.ndarray) -> np.ndarray:
    """How often every row is drawn for a tree."""
    start = np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = _mix(_mix(row.astype(np.uint64) + start) + start)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def some_features(seed: int, tree: int, node: int, level: int, n: int, d: int) -> np.ndarray:
    """The features that ``n`` nodes of a level may be split by: the square root of their number, rounded up."""
    m = math.ceil(math.sqrt(d))
    order = np.random.default_rng([seed, tree, node + 1, level]).random((n, d))
    return np.argpartition(order, m - 1, axis=1)[:, :m] if m < d else np.tile(np.arange(d), (n, 1))


def best_splits(h: np.ndarray, weights: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the feature, last bin of the left side and gain (times weight) of histograms (nodes, features, bins, classes);
    a gain of zero stands for no split."""
    n, m, b, _ = h.shape
    left = h.cumsum(axis=2)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    enough = (left.sum(-1) >= min_leaf) & (right.sum(-1) >= min_leaf)
    score = np.zeros((n, m, b - 1))
    for side in (left, right):
        side = side * weights
        score += np.divide((side * side).sum(-1), side.sum(-1), out=np.zeros((n, m, b - 1)), where=enough)
    whole = total[:, 0, 0] * weights
    whole = (whole * whole).sum(-1) / np.maximum(whole.sum(-1), 1e-300)
    score = np.where(enough, score - whole[:, None, None], 0.0).reshape(n, -1)
    best = score.argmax(axis=1)
    gain = score[np.arange(n), best]
    return best // (b - 1), best % (b - 1), np.where(gain > 1e-9 * np.maximum(whole, 1e-300), gain, 0.0)


def histograms(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, chosen: np.ndarray, classes: int) -> np.ndarray:
    """Drawn rows by (node, chosen feature, bin, class)."""
    n, m = chosen.shape
    value = np.take_along_axis(bins, chosen[at], axis=1).astype(np.int64)
    place = ((at[:, None] * m + np.arange(m)) * BINS + value) * classes + y[:, None]
    return np.bincount(place.ravel(), np.repeat(w, m), n * m * BINS * classes).reshape(n, m, BINS, classes)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_leaf: int, weights: np.ndarray, address: tuple[int, int, int]) -> dict:
    """The subtree of some rows: nodes by level, as arrays, and the gain of every feature."""
    classes, d = len(weights), bins.shape[1]
    out, gains = {"feature": [], "cut": [], "left": [], "counts": []}, np.zeros(d)
    row, at, n, made = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 0
    for level in range(depth + 1):
        counts = np.bincount(at * classes + y[row], w[row], n * classes).reshape(n, classes)
        feature, cut = np.full(n, -1, np.int16), np.zeros(n, np.uint8)
        asked = np.flatnonzero((counts.sum(1) >= 2 * min_leaf) & ((counts > 0).sum(1) > 1)) if level < depth else []
        if len(asked):
            chosen = some_features(*address, level, len(asked), d)
            place = np.full(n, -1)
            place[asked] = np.arange(len(asked))
            of = place[at]
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(0, len(asked) + _NODES, _NODES))
            for i, (a, b) in zip(range(0, len(asked), _NODES), zip(ends, ends[1:])):
                here = order[a:b]
                h = histograms(bins[row[here]], y[row[here]], w[row[here]], of[here] - i, chosen[i:i + _NODES], classes)
                which, last, gain = best_splits(h, weights, min_leaf)
                good = np.flatnonzero(gain > 0)
                f = chosen[i + good, which[good]]
                feature[asked[i + good]], cut[asked[i + good]] = f, last[good]
                np.add.at(gains, f, gain[good])
        split = feature >= 0
        child = 2 * (np.cumsum(split) - 1)
        for name, value in (("feature", feature), ("cut", cut), ("left", np.where(split, made + n + child, -1).astype(np.int32)), ("counts", counts.astype(np.int32))):
            out[name].append(value)
        go = split[at]
        row, at = row[go], at[go]
        at = child[at] + (bins[row, feature[at]] > cut[at])
        made, n = made + n, 2 * int(split.sum())
        if not n:
            break
    return {**{k: np.concatenate(v) for k, v in out.items()}, "gains": gains}


def walk(trees: Trees, root: int, bins: np.ndarray) -> np.ndarray:
    """Leaf of every row."""
    at, go = np.full(len(bins), root), np.arange(len(bins))
    for _ in range(trees.depth + 1):
        f = trees.feature[at[go]]
        inner = f >= 0
        if not inner.any():
            break
        go, f = go[inner], f[inner]
        here = at[go]
        at[go] = trees.left[here] + (bins[go, f] > trees.cut[here])
    return at


def assemble(rows: list[dict], classes: int, depth: int) -> Trees:
    """Subtrees put in the places of the nodes above them; rows are (tree, node) with buffers."""
    parts = {"feature": [], "cut": [], "left": [], "counts": []}
    kinds, roots, end = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "counts": np.int32}, [], 0
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r["tree"], {})[r["node"]] = {k: np.frombuffer(r[k], t) for k, t in kinds.items()}
    for tree in sorted(by_tree):
        subs = by_tree[tree]
        top = {k: v.copy() for k, v in subs.pop(-1).items()}
        top["counts"] = top["counts"].reshape(-1, classes)
        flat = {k: [v] for k, v in top.items()}
        size = len(top["feature"])
        for node, sub in sorted(subs.items()):
            sub = {**sub, "counts": sub["counts"].reshape(-1, classes)}
            moved = np.where(sub["left"] >= 0, sub["left"] - 1 + size, -1).astype(np.int32)   # its root stands in the node's place
            for k in kinds:
                value = moved if k == "left" else sub[k]
                top[k][node] = value[0]
                flat[k].append(value[1:])
            size += len(moved) - 1
        roots.append(end)
        for k in kinds:
            value = np.concatenate(flat[k])
            parts[k].append(np.where(value >= 0, value + end, -1) if k == "left" else value)
        end += size
    return Trees(*(np.concatenate(parts[k]) for k in kinds), np.array(roots), depth)


def binned(model_scale: StandardScalerModel, cuts: np.ndarray, df: DataFrame, carry: dict) -> DataFrame:
    """``carry`` columns and ``bins``, a byte a value."""
    rows = model_scale.transform(df).select(*[c.alias(n) for n, c in carry.items()], vector_to_array("_scaled").alias("_x"))
    kinds, names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_x").schema.fields], list(carry)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            b = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([r.tobytes() for r in b], pa.binary())], [*names, "bins"])

    return rows.mapInArrow(cut, ", ".join([*kinds, "bins binary"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def limits(scaled: DataFrame, d: int) -> np.ndarray:
    """Limits of the bins of every feature (``inf`` where it has fewer): midpoints at quantiles of a sample."""
    sample = scaled.select(vector_to_array("_scaled").alias("x"), F.xxhash64(vector_to_array("_scaled")).alias("h")).orderBy("h", "x").limit(SAMPLE)
    x = np.array([r for r in sample.select("x").toArrow().column("x").to_pylist()], float).reshape(-1, d)
    out = np.full((d, BINS - 1), np.inf)
    for j in range(d):
        v = np.unique(x[:, j])
        if len(v) > BINS:
            v = np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower"))
            at = np.searchsorted(u := np.unique(x[:, j]), v)
            mid = (u[at] + u[np.minimum(at + 1, len(u) - 1)]) / 2
            mid = mid[at + 1 < len(u)]
        else:
            mid = (v[:-1] + v[1:]) / 2
        out[j, :len(mid)] = mid
    return out


def _upper_splits(rows: DataFrame, total: int, d: int, trees: int, depth: int, min_leaf: int, weights: np.ndarray, seed: int) -> list[dict]:
    """The nodes above ``ROWS`` drawn rows of every tree, with the rows of each (runs a job per pass). ``grown`` marks the nodes
    below which a subtree is to be grown."""
    spark, classes = rows.sparkSession, len(weights)
    tops = [{"feature": [-1], "cut": [0], "left": [-1], "level": [0], "counts": [[0] * classes], "grown": [True], "gains": np.zeros(d)} for _ in range(trees)]
    todo = [(t, 0) for t in range(trees)] if total > ROWS and depth else []
    while todo:
        now, todo = todo[:OPEN], todo[OPEN:]
        shared = spark.sparkContext.broadcast((tuple(_upper_trees(tops, classes, depth)), now))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            upper, now = Trees(*shared.value[0]), shared.value[1]
            wanted = {}
            for t, node in now:
                wanted.setdefault(t, []).append(node)
            chosen = {t: np.concatenate([some_features(seed, t, node, -1 % 2**32, 1, d) for node in nodes]) for t, nodes in wanted.items()}
            sums = {t: 0 for t in wanted}
            for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
                bins, y, row = _matrix(batch.column("bins")), batch.column("y").to_numpy(), batch.column("row").to_numpy()
                for t, nodes in wanted.items():
                    w, at = drawn(seed, t, row), walk(upper, upper.roots[t], bins) - upper.roots[t]
                    place = np.full(int(at.max()) + 1 if len(at) else 1, -1)
                    known = np.array(nodes)
                    place[known[known < len(place)]] = np.flatnonzero(known < len(place))
                    mine = np.flatnonzero((w > 0) & (place[at] >= 0))
                    sums[t] = sums[t] + histograms(bins[mine], y[mine], w[mine], place[at[mine]], chosen[t], classes).astype(np.int32)
            for t, nodes in wanted.items():
                if not np.isscalar(sums[t]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t, np.int32)), pa.array(np.array(nodes, np.int32)), pa.array([h.tobytes() for h in sums[t]])], ["tree", "node", "h"])

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            t, node = key[0].as_py(), key[1].as_py()
            h = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in table.column("h").to_pylist())
            h = h.reshape(1, -1, BINS, classes)
            which, last, gain = best_splits(h, weights, min_leaf)
            f = int(some_features(seed, t, node, -1 % 2**32, 1, d)[0, which[0]])
            whole, left = h[0, 0].sum(axis=0), h[0, which[0], :last[0] + 1].sum(axis=0)
            return pa.table({"tree": [t], "node": [node], "feature": [f], "cut": [int(last[0])], "gain": [float(gain[0])], "whole": [whole.tolist()], "left": [left.tolist()]})

        found = rows.mapInArrow(add, "tree int, node int, h binary").groupBy("tree", "node").applyInArrow(
            choose, "tree long, node long, feature long, cut long, gain double, whole array<long>, left array<long>").collect()
        for r in sorted(found, key=lambda r: (r.tree, r.node)):
            top = tops[r.tree]
            top["counts"][r.node] = list(r.whole)
            if r.gain <= 0:
                top["grown"][r.node] = False
                continue
            top["feature"][r.node], top["cut"][r.node], top["left"][r.node], top["grown"][r.node] = r.feature, r.cut, len(top["feature"]), False
            top["gains"][r.feature] += r.gain
            for counts in (list(r.left), [a - b for a, b in zip(r.whole, r.left)]):
                level = top["level"][r.node] + 1
                for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("level", level), ("counts", counts)):
                    top[k].append(v)
                ends = level == depth or sum(c > 0 for c in counts) < 2
                top["grown"].append(not ends)
                if sum(counts) > ROWS and not ends:
                    todo.append((r.tree, len(top["feature"]) - 1))
    return tops


def _upper_trees(tops: list[dict], classes: int, depth: int) -> Trees:
    roots = np.cumsum([0, *[len(t["feature"]) for t in tops]])
    left = np.concatenate([np.where(np.array(t["left"]) >= 0, np.array(t["left"]) + r, -1) for t, r in zip(tops, roots)])
    return Trees(np.concatenate([t["feature"] for t in tops]).astype(np.int16), np.concatenate([t["cut"] for t in tops]).astype(np.uint8), left,
                 np.concatenate([np.reshape(t["counts"], (-1, classes)) for t in tops]), roots, depth)


def portions(n: int, size: float) -> list[range]:
    """``0`` to ``n - 1`` in ranges whose members, of ``size`` bytes each, come to ``SHUFFLED`` at most, if one does."""
    step = max(1, min(n, int(SHUFFLED // max(size, 1))))
    return [range(i, min(i + step, n)) for i in range(0, n, step)]


def fit(train: DataFrame, labels: list[str], class_weights: list[float], scale: StandardScalerModel, trees: int, depth: int, min_leaf: int, seed: int) -> ForestModel:
    """``train`` has ``features`` and ``_label``, the place of the label (runs jobs)."""
    spark, weights, d = train.sparkSession, np.array(class_weights), len(scale.mean)
    cuts = limits(scale.transform(train), d)
    # rows are drawn by their place in the written table
    rows = materialize(binned(scale, cuts, train, {"y": F.col("_label").cast("long"), "row": F.monotonically_increasing_id()}), "forest-rows")
    total = rows.count()
    tops = _upper_splits(rows, total, d, trees, depth, min_leaf, weights, seed)
    shared = spark.sparkContext.broadcast((tuple(_upper_trees(tops, len(weights), depth)), [np.array(t["grown"]) for t in tops], [t["level"] for t in tops]))

    def deal(batches: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
        upper, grown = Trees(*shared.value[0]), shared.value[1]
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, len(b), BLOCK)):
            bins, y, row = _matrix(batch.column("bins")), batch.column("y").to_numpy().astype(np.uint16), batch.column("row").to_numpy()
            for t in some:
                w, at = drawn(seed, t, row), walk(upper, upper.roots[t], bins) - upper.roots[t]
                mine = np.flatnonzero((w > 0) & grown[t][at])
                if not len(mine):
                    continue
                mine = mine[np.argsort(at[mine], kind="stable")]
                ends = np.flatnonzero(np.diff(at[mine])) + 1
                parts = np.split(mine, ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parts), t, np.int32)), pa.array(np.array([at[p[0]] for p in parts], np.int32)),
                     *(pa.array([v[p].tobytes() for p in parts], pa.binary()) for v in (bins, y, w))], ["tree", "node", "bins", "y", "w"])

    def below(key: tuple, table: pa.Table) -> pa.Table:
        t, node = key[0].as_py(), key[1].as_py()
        bins, y, w = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("bins", np.uint8), ("y", np.uint16), ("w", np.uint8)))
        made = grow(bins.reshape(len(y), d), y.astype(np.int64), w.astype(float), depth - shared.value[2][t][node], min_leaf, weights, (seed, t, node))
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()),
                         **{k: pa.array([made[k].tobytes()], pa.binary()) for k in ("feature", "cut", "left", "counts")}, "gains": pa.array([made["gains"]], pa.list_(pa.float64()))})

    path, of_tree = scratch_path(spark, "forest"), 0.64 * total * (d + 3)
    for some in portions(trees, of_tree):
        parts = max(4 * spark.sparkContext.defaultParallelism, math.ceil(len(some) * of_tree / _PART_BYTES))
        with shuffles_freed(spark):
            dealt = rows.mapInArrow(lambda batches, some=some: deal(batches, some), "tree int, node int, bins binary, y binary, w binary").repartition(parts, "tree", "node")
            dealt.groupBy("tree", "node").applyInArrow(below, TREES_SCHEMA).write.mode("append").parquet(path)
    kinds = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "counts": np.int32}
    upper = [(t, -1, *(np.array(top[k], v).tobytes() for k, v in kinds.items()), top["gains"].tolist()) for t, top in enumerate(tops)]
    spark.createDataFrame(upper, TREES_SCHEMA).write.mode("append").parquet(path)
    return ForestModel(list(labels), list(class_weights), scale, cuts, trees, depth, path)


def subtrees(spark: SparkSession, model: ForestModel) -> DataFrame:
    return spark.read.schema(TREES_SCHEMA).parquet(model.path)


def votes(trees: Trees, leaves: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Class shares of leaves; a tree without rows votes for no class."""
    c = trees.counts[leaves] * weights
    total = c.sum(axis=-1, keepdims=True)
    return np.divide(c, total, out=np.zeros_like(c), where=total > 0)


def probabilities(model: ForestModel, df: DataFrame, row: str) -> DataFrame:
    """``row, probabilities`` of rows with ``features``, ``row`` being their number (runs jobs)."""
    spark, weights, classes = df.sparkSession, np.array(model.class_weights), len(model.labels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                numbers = batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(numbers[:1]), pa.array([numbers.tobytes()]), pa.array([b"".join(batch.column("bins").to_pylist())])], ["block", "rows", "bins"])

    blocks = materialize(binned(model.scale, model.cuts, df, {"row": F.col(row)}).mapInArrow(pack, "block long, rows binary, bins binary"), "blocks")
    n = blocks.agg(F.sum(F.length("rows") / 8)).first()[0] or 0
    shares, groups = max(1, math.ceil(n / SHARE)), math.ceil(model.trees / GROUP)
    held = subtrees(spark, model).select(
        F.floor(F.col("tree") / GROUP).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"),
        "tree", "node", "feature", "cut", "left", "counts", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("bins"))
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("tree", "int"), ("node", "int"), ("feature", "binary"), ("cut", "binary"), ("left", "binary"), ("counts", "binary"))]
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"),
                          F.lit(1).alias("kind"), *nothing, "block", "bins")
    d, depth = len(model.cuts), model.depth

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rows, trees = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["share"]) != of:
                    of, rows, trees = (r["group"], r["share"]), [], None
                if r["kind"] == 0:
                    rows.append(r)
                    continue
                if trees is None:
                    trees, rows = assemble(rows, classes, depth), []
                bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, d)
                total = sum(votes(trees, walk(trees, root, bins), weights) for root in trees.roots)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([np.ascontiguousarray(total).tobytes()])], ["block", "votes"])

    tasks = max(2 * spark.sparkContext.defaultParallelism, groups * shares)
    voted = held.unionByName(asked).repartition(tasks, "group", "share").sortWithinPartitions("group", "share", "kind").mapInArrow(vote, "block long, votes binary")

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, float) for b in sorted(x for x in table.column("votes").to_pylist() if x is not None)).reshape(-1, classes)
        rows = np.frombuffer(next(x for x in table.column("rows").to_pylist() if x is not None), np.int64)
        shares = (total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)).round(9)
        shares = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        return pa.table({row: rows, "probabilities": pa.array(list(shares), pa.list_(pa.float64()))})

    both = voted.select("block", "votes", F.lit(None).cast("binary").alias("rows")).union(blocks.select("block", F.lit(None).cast("binary"), "rows"))
    return both.groupBy("block").applyInArrow(add, f"{row} long, probabilities array<double>")


def importances(spark: SparkSession, model: ForestModel) -> list[float]:
    """Share of every feature in the gains, each tree counting alike."""
    of = subtrees(spark, model).select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g"))
    whole = of.groupBy("tree").agg(F.sum("g").alias("whole")).filter("whole > 0")
    mean = {r.f: r.v for r in of.join(whole, "tree").groupBy("f").agg(F.sum(F.col("g") / F.col("whole")).alias("v")).collect()}
    total = sum(mean.values()) or 1.0
    return [mean.get(j, 0.0) / total for j in range(len(model.cuts))]


def changed_predictions(trees: Trees, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Class of every row with each of its features in turn taken from ``y``."""
    n, d = x.shape
    total, delta = np.zeros((n, len(weights))), np.zeros((n * d, len(weights)))
    for root in trees.roots:
        at, go, turned = np.full(n, root), np.arange(n), []
        for _ in range(trees.depth + 1):
            f = trees.feature[at[go]]
            inner = f >= 0
            if not inner.any():
                break
            go, f = go[inner], f[inner]
            here = at[go]
            side, other = x[go, f] > trees.cut[here], y[go, f] > trees.cut[here]
            off = np.flatnonzero(side != other)
            turned.append((go[off], f[off].astype(np.int64), trees.left[here[off]] + other[off]))
            at[go] = trees.left[here] + side
        mine = votes(trees, at, weights)
        total += mine
        if not turned:
            continue
        row, f, start = (np.concatenate(c) for c in zip(*turned))
        _, first = np.unique(row * d + f, return_index=True)     # a path may ask for a feature again: the first change counts
        row, f, place = row[first], f[first], start[first].copy()
        left = np.arange(len(row))
        for _ in range(trees.depth + 1):
            asked = trees.feature[place[left]]
            inner = asked >= 0
            if not inner.any():
                break
            left, asked = left[inner], asked[inner]
            r, here = row[left], place[left]
            place[left] = trees.left[here] + (np.where(asked == f[left], y[r, asked], x[r, asked]) > trees.cut[here])
        delta[row * d + f] += votes(trees, place, weights) - mine[row]
    # Votes are sums of shares in another order than the model's: equal up to rounding counts as equal.
    return ((total[:, None, :] + delta.reshape(n, d, -1)) / max(len(trees.roots), 1)).round(9).argmax(axis=2)


def permuted_counts(rows: DataFrame, model: ForestModel, positive: int) -> DataFrame:
    """``seed, feature, tp, fp, fn`` from rows of ``is_positive, seed, x, y`` (bins of the row and of the donor). Every task holds
    all trees, whose number of nodes depends on the depth alone."""
    spark, weights = rows.sparkSession, np.array(model.class_weights)
    table = subtrees(spark, model).drop("gains").toArrow().to_pylist()
    shared = spark.sparkContext.broadcast(tuple(assemble(table, len(weights), model.depth)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums = Trees(*shared.value), {}
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
            real, hit = batch.column("is_positive").to_numpy(zero_copy_only=False)[:, None], changed_predictions(trees, weights, x, y) == positive
            seeds = batch.column("seed").to_numpy()
            for seed in np.unique(seeds):
                of = seeds == seed
                cells = np.stack([(a[of] & b[of]).sum(axis=0) for a, b in ((hit, real), (hit, ~real), (~hit, real))])
                sums[seed] = sums.get(seed, 0) + cells
        for seed, cells in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(cells.shape[1], seed, np.int32)), pa.array(np.arange(cells.shape[1], dtype=np.int32)), *(pa.array(c.astype(np.int64)) for c in cells)],
                ["seed", "feature", "tp", "fp", "fn"])

    out = rows.mapInArrow(count, "seed int, feature int, tp long, fp long, fn long").groupBy("seed", "feature")
    return out.sum("tp", "fp", "fn").toDF("seed", "feature", "tp", "fp", "fn")
