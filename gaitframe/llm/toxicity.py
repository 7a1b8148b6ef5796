"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. A text's features are the distinct buckets of its words, of pairs of neighbouring words and of pairs
with one word between. FTRL-proximal reads a bounded sample of labelled texts in a fixed order, a few times:
every coordinate has a learning rate of its own and an L1 threshold below which its weight is exactly zero,
so the model is a short list of (bucket, weight) that is broadcast for scoring. Scoring is one pass over all
texts with array operations.

Bounds. ``sample`` labelled rows are read for training (16,000; their features fill about 80 MB), in one task
because FTRL is an online method; the model has at most as many weights as the sample has features and in
practice a few hundred.

Cases. Null and empty texts have no features and get the score of the bias. Without training rows every score
is 0.5, with one class only the fit still ends. Repeated rows are scored alike; all other columns stay.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.llm import textvec
from gaitframe.llm.labels import training_rows

BITS = 22


class Model(NamedTuple):
    bucket: np.ndarray
    weight: np.ndarray
    bias: float


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, neighbouring pair and pair around one word; repeats included."""
    w = textvec.words(data, at)
    h, text = textvec.word_hashes(w), w.text_of_word()
    all_text, all_bucket = [text], [h >> np.uint64(64 - BITS)]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) <= gap:
            break
        same = text[gap:] == text[:-gap]
        pair = textvec.mix(h[:-gap] * np.uint64(0x100000001B3) + h[gap:] + np.uint64(salt))
        all_text.append(text[gap:][same])
        all_bucket.append(pair[same] >> np.uint64(64 - BITS))
    return np.concatenate(all_text), np.concatenate(all_bucket).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> Model:
    """FTRL-proximal over (distinct buckets, label) rows, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0, n0 = 0.0, 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    bias = 0.0
    for _ in range(passes):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            bias = -z0 / ((beta + np.sqrt(n0)) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            z0, n0 = z0 + g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * bias, n0 + g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return Model(kept.astype(np.uint32), weights(z[kept], n[kept]).astype(np.float64), float(bias))


def scores(model: Model, known: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities; ``known`` marks the buckets of the model."""
    text, bucket = features(data, at)
    hit = known[bucket]
    pairs = np.unique((text[hit].astype(np.int64) << BITS) | bucket[hit])
    place = np.searchsorted(model.bucket, (pairs & ((1 << BITS) - 1)).astype(np.uint32))
    total = np.bincount(pairs >> BITS, weights=model.weight[place], minlength=len(at) - 1) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, sample: int = 16_000,
          text: str = "text", doc_id: str = "doc_id", **options) -> Model:
    """Fits on labelled rows outside the held-out fold (runs jobs)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in textvec.slices(batch.column("text")):
                of, bucket = features(data, at)
                cut = np.searchsorted(of := of[(order := np.argsort(of, kind="stable"))], np.arange(j - i + 1))
                bucket = bucket[order]
                rows = [np.unique(bucket[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i),
                                                  pa.array(rows, pa.binary())], ["doc_id", "label", "bag"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(b, np.uint32), y) for batch in batches
                for b, y in zip(batch.column("bag").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        model = fit(rows, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.bucket.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.bias])],
                                         ["bucket", "weight", "bias"])

    rows = training_rows(docs, labels, label, folds, held_out, sample, text, doc_id)
    ordered = rows.mapInArrow(bags, "doc_id long, label int, bag binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "bag")
    made = ordered.mapInArrow(learn, "bucket binary, weight binary, bias double").first()
    if made is None:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    return Model(np.frombuffer(made.bucket, np.uint32), np.frombuffer(made.weight, np.float64), made.bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of the label as a double."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf(T.DoubleType())
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*shared.value)
        known = np.zeros(1 << BITS, dtype=bool)
        known[model.bucket] = True
        for column in batches:
            parts = [scores(model, known, data, at) for _, _, data, at in textvec.slices(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, probability(F.col(text)))
