"""A small network over raw windows with balanced classes: one hidden layer, focal loss, gradients summed on Spark.

Spark ML's perceptron takes no class weights. Here every round sums the exact gradient of the weighted loss over all training
rows: a task adds up its rows' part, ``SUMS`` tasks add up those, and the driver takes one step (Adam, cosine rate). What
travels is as large as the parameters, whatever the number of rows. The loss of a row is ``-weight * (1 - p) ** gamma *
log p`` for the probability ``p`` of its class; weights are the balanced ones, so rare falls count as much as long walks.

Cases. Missing values are 0, as for the other models; a constant column is left out by its scale. Rows whose class was not
seen are predicted like any other. Without training rows fitting is an error.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.session import materialize

SUMS = 8
BLOCK = 2048


class Network(NamedTuple):
    """Class names in order, column means and scales, and the two layers."""

    labels: list[str]
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]


def _probabilities(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    z = hidden @ w2 + b2
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return hidden, p / p.sum(axis=1, keepdims=True)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, layers: list[np.ndarray], gamma: float) -> tuple[float, list[np.ndarray]]:
    """Summed loss of standardised rows and its gradient; ``weight`` is per class."""
    hidden, p = _probabilities(x, layers)
    own = np.clip(p[np.arange(len(y)), y], 1e-12, 1.0)
    log, rest = np.log(own), 1 - own
    pull = weight[y] * (gamma * np.power(rest, max(gamma - 1, 0.0)) * own * log * (gamma > 0) - np.power(rest, gamma))
    z = -pull[:, None] * p
    z[np.arange(len(y)), y] += pull
    back = (z @ layers[2].T) * (1 - hidden ** 2)
    return float(-(weight[y] * np.power(rest, gamma) * log).sum()), [x.T @ back, back.sum(axis=0), hidden.T @ z, z.sum(axis=0)]


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum over all rows of ``of(x, y)``, a vector of fixed size, block by block."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                some = batch.slice(i, BLOCK)
                total += of(some.column("x").flatten().to_numpy().reshape(len(some), -1), some.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()])], ["place", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for row in batch.column("sums"):
                total, some = total + np.frombuffer(row.as_py()), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    parts = rows.mapInArrow(part, "place int, sums binary").repartition(SUMS, "place").select("sums").mapInArrow(add, "sums binary").collect()
    return np.sum([np.frombuffer(r.sums) for r in parts], axis=0)


def fit_network(train: DataFrame, hidden: int = 32, gamma: float = 2.0, rounds: int = 60, rate: float = 0.02, decay: float = 1e-4,
                seed: int = 42) -> Network:
    """Fits on ``features`` and ``label`` (runs a job per round; the packed rows are a written table)."""
    counts = {r.label: r.n for r in train.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no labelled rows to fit on")
    labels = sorted(counts)
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    x = F.transform(vector_to_array("features"), lambda v: F.when(F.isnan(v), 0.0).otherwise(v))
    rows = materialize(train.filter("label IS NOT NULL").select(x.alias("x"), place.cast("long").alias("y")), "packed-windows")
    width, classes, n = rows.select(F.size("x").alias("n")).first().n, len(labels), sum(counts.values())
    moments = _summed(rows, lambda x, y: np.concatenate([x.sum(axis=0), (x ** 2).sum(axis=0)]), 2 * width)
    mean = moments[:width] / n
    spread = np.sqrt(np.maximum(moments[width:] / n - mean ** 2, 0.0))
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    weight = np.array([n / (classes * counts[c]) for c in labels])
    rng, shapes = np.random.default_rng(seed), [(width, hidden), (hidden,), (hidden, classes), (classes,)]
    layers = [rng.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s) for s in shapes]
    cut = np.cumsum([int(np.prod(s)) for s in shapes])
    first, second = (np.zeros(cut[-1]) for _ in range(2))
    for step in range(1, rounds + 1):
        now = layers

        def gradient(x: np.ndarray, y: np.ndarray, now=now) -> np.ndarray:
            return np.concatenate([g.ravel() for g in loss_and_gradient((x - mean) * scale, y, weight, now, gamma)[1]])

        g = _summed(rows, gradient, int(cut[-1])) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        pace = rate * 0.5 * (1 + np.cos(np.pi * (step - 1) / rounds))
        layers = [p - pace * (m.reshape(p.shape) + decay * p) for p, m in zip(layers, np.split(move, cut[:-1]), strict=True)]
    return Network(labels, mean, scale, layers)


def predict_network(net: Network, df: DataFrame) -> DataFrame:
    """``df`` without ``features``, with ``prediction`` and ``probabilities`` in the order of the network's labels."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(net))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def probabilities(column: pa.Array) -> pa.Array:
        net = Network(*shared.value)
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(net.mean)))
        p = _probabilities((np.nan_to_num(x) - net.mean) * net.scale, net.layers)[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))

    scored = df.withColumn("probabilities", probabilities(vector_to_array("features"))).drop("features")
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return scored.withColumn("prediction", F.element_at(F.array(*map(F.lit, net.labels)), best))
