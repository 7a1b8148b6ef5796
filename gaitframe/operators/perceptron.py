"""Spark ML's perceptron with its gradients summed in arrays: the same network, loss, start and optimiser, other arithmetic.

Spark ML multiplies small blocks of rows in the JVM, which takes most of a fit over many wide rows. Here the scaled rows are
packed once into blocks and kept by the executors (memory, else disk); a pass multiplies the blocks and sums the loss and
gradient of all rows per task, and the driver takes one step of L-BFGS. A pass is one job without SQL planning; what
travels is as large as the parameters times the tasks. The fitted model is Spark ML's, so scoring, saving and pipelines stay.

Scaled values are kept and multiplied in single precision (24 bits, where sensors give 16), which halves what a pass moves;
losses, the sums over blocks and the optimiser are in double precision.

Cases. Every row counts the same (Spark ML weighs blocks the same, also short ones). Rows that give no finite loss and a table
without rows are errors.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: Tasks whose sums the driver adds up itself; those of more tasks are added up on the cluster before.
DIRECT = 64
MEMORY, SEARCHES, LOOK_BACK = 10, 20, 20
DECREASE, CURVATURE = 1e-4, 0.9

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs by outputs) and offsets of every layer, in the order of Spark ML's weights."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + (n + 1) * m]))
        at += (n + 1) * m
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: Sequence[int]) -> tuple[float, np.ndarray]:
    """Summed cross entropy of the rows (logistic hidden layers, softmax at the end) and its gradient by ``weights``,
    multiplied in the precision of ``x``."""
    layers, inputs = _layers(weights.astype(x.dtype), sizes), [x]
    for w, b in layers[:-1]:
        inputs.append(0.5 * (1 + np.tanh(0.5 * (inputs[-1] @ w + b))))
    z = inputs[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    p, at = np.exp(z), np.arange(len(y))
    total = p.sum(axis=1)
    loss = float((np.log(total) - z[at, y]).sum(dtype=float))
    back = p / total[:, None]
    back[at, y] -= 1
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts = [(inputs[k].T @ back).ravel(), back.sum(axis=0), *parts]
        if k:
            back = (back @ layers[k][0].T) * inputs[k] * (1 - inputs[k])
    return loss, np.concatenate(parts)


def pack(rows: DataFrame) -> RDD:
    """Blocks (single precision values, class numbers) of rows with ``x`` and ``y``, spread evenly over the tasks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                some = batch.slice(i, BLOCK)
                cells = [some.column("x").flatten().to_numpy().astype(np.float32).tobytes(), some.column("y").to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["x", "y"])

    even = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return even.mapInArrow(blocks, "x binary, y binary").rdd.map(lambda r: (bytes(r.x), bytes(r.y)))


def mean_loss(blocks: RDD, sizes: Sequence[int]) -> Loss:
    """Mean loss and gradient over all rows of ``blocks``; every call is a job."""
    depth = 1 if blocks.getNumPartitions() <= DIRECT else 2

    def of(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def part(some: Iterator[tuple[bytes, bytes]]) -> Iterator[np.ndarray]:
            total = np.zeros(2 + len(weights))
            for x, y in some:
                own = np.frombuffer(y, np.int64)
                loss, gradient = loss_and_gradient(np.frombuffer(x, np.float32).reshape(len(own), -1), own, weights, sizes)
                total[0] += len(own)
                total[1] += loss
                total[2:] += gradient
            yield total

        total = blocks.mapPartitions(part).treeReduce(np.add, depth)
        if not total[0]:
            raise ValueError("no rows to fit on")
        return float(total[1] / total[0]), total[2:] / total[0]

    return of


def _between(low: tuple, high: tuple) -> float:
    """Where the cubic through two points with slopes is smallest, kept off the ends."""
    (a, fa, sa, _), (b, fb, sb, _) = low, high
    d1 = sa + sb - 3 * (fa - fb) / (a - b)
    root = d1 * d1 - sa * sb
    middle = (a + b) / 2
    if not np.isfinite(root) or root < 0:
        return middle
    d2 = np.sign(b - a) * np.sqrt(root)
    at = b - (b - a) * (sb + d2 - d1) / (sb - sa + 2 * d2) if sb - sa + 2 * d2 else middle
    ends = sorted((a + 0.1 * (b - a), b - 0.1 * (b - a)))
    return float(np.clip(at, *ends)) if np.isfinite(at) else middle


def _search(of: Loss, w: np.ndarray, f: float, g: np.ndarray, d: np.ndarray, step: float) -> tuple | None:
    """Step along ``d`` by the strong Wolfe conditions, with its loss, slope and gradient; None if nothing is lower."""
    slope = float(g @ d)
    low, high = (0.0, f, slope, g), None
    for _ in range(SEARCHES):
        value, gradient = of(w + step * d)
        now = (step, value, float(gradient @ d), gradient)
        if not np.isfinite(value) or value > f + DECREASE * step * slope or (low[0] and value >= low[1]):
            high = now
        elif abs(now[2]) <= -CURVATURE * slope:
            return now
        else:
            if now[2] * (high[0] - low[0] if high else 1.0) >= 0:
                high = low
            low = now
        step = _between(low, high) if high else 2 * step
    return low if low[0] else None


def minimize(of: Loss, w: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """L-BFGS with ten corrections; it stops as Spark ML's does: at ``iterations``, at a small gradient, or where the last
    twenty losses gained less than ``tolerance`` of the first one."""
    f, g = of(w)
    if not np.isfinite(f):
        raise ValueError("the rows give no finite loss: missing or infinite features?")
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    losses = [f]
    for _ in range(iterations):
        if np.linalg.norm(g) <= tolerance * max(abs(f), 1e-8):
            break
        d, kept = -g, []
        for s, c in reversed(steps):
            kept.append(s @ d / (s @ c))
            d = d - kept[-1] * c
        if steps:
            s, c = steps[-1]
            d = d * (s @ c / (c @ c))
        for (s, c), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - c @ d / (s @ c)) * s
        found = _search(of, w, f, g, d, 1.0 if steps else 1 / np.linalg.norm(d))
        if found is None:
            break
        s, c = found[0] * d, found[3] - g
        if s @ c > 0:
            steps = [*steps, (s, c)][-MEMORY:]
        w, f, g = w + s, found[1], found[3]
        losses.append(f)
        if abs(f - max(losses[-LOOK_BACK:])) <= tolerance * losses[0]:
            break
    return w


class ArrayPerceptron(MultilayerPerceptronClassifier):
    """``MultilayerPerceptronClassifier`` that fits by arrays (L-BFGS only) and gives Spark ML's model (a job per pass)."""

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        sizes = self.getLayers()
        label = F.col(self.getLabelCol()).cast("long").alias("y")
        blocks = pack(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), label)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        try:
            start = self._model(dataset).weights.toArray()
            weights = minimize(mean_loss(blocks, sizes), start, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        return self._model(dataset, weights)

    def _model(self, dataset: DataFrame, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
        """Spark ML's model with ``weights``, or with those that its seed draws, by a fit of no iterations on one row."""
        plain = MultilayerPerceptronClassifier(
            featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
            probabilityCol=self.getProbabilityCol(), rawPredictionCol=self.getRawPredictionCol(),
            layers=self.getLayers(), maxIter=0, seed=self.getSeed())
        if weights is not None:
            plain.setInitialWeights(Vectors.dense(weights))
        one = dataset.sparkSession.createDataFrame([(Vectors.sparse(self.getLayers()[0], {}), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        return plain.fit(one)
