"""Document quality by a linear-chain conditional random field over lines.

Method. Every line is labelled good or bad. A line's features are shares of character classes and of words that
repeat the word before them, word and line length, those of the line before and after it, and whether these exist; a 2 x 2 transition matrix ties
neighbouring labels. Training takes the label of the document for all its lines and maximises the penalised
likelihood. A document's score is the mean of its lines' marginals from the forward-backward recursion,
weighted by length in bytes. With two labels the messages are single log-odds, so a whole batch of texts
moves one line per step in array operations.

Bounds. ``sample`` labelled rows are read for training (6,000), reduced to a few numbers per line and fitted in
one task; the model is some 40 numbers. The fit and the scores use all lines of their texts.

Cases. Null and empty texts are one empty line. Without training rows every score is 0.5; with one class only
the fit still ends. Repeated rows are scored alike; all other columns stay.
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

#: Character classes of the features: upper, lower, digit, mark of exclamation, bar, other symbol, stop, non-ASCII, blank.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[33], _CLASS[124] = 0, 1, 2, 3, 4
_CLASS[[44, 46, 58, 59, 63, 39, 34, 40, 41, 45]] = 6
_CLASS[128:], _CLASS[:33] = 7, 8
CLASSES = 9
OWN = CLASSES + 4
WIDTH = 3 * OWN + 3


class Model(NamedTuple):
    """Weights of the standardised features for "good", and transition scores [from, to] with 1 = good."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    move: np.ndarray


def observe(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the first line of each text (one line at least)."""
    breaks = np.flatnonzero(data == 10) if len(data) else np.zeros(0, np.int64)
    start = np.concatenate([at[:-1], breaks + 1])
    text = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    first = np.searchsorted(text, np.arange(len(at)))
    last = np.ones(len(start), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    end = np.where(last, at[text + 1], np.append(start[1:], 0) - 1)
    kind = _CLASS[data]
    own = np.zeros((len(start), OWN))
    size = np.maximum(end - start, 1)
    total = np.zeros(len(data) + 1, np.int64)
    for c in range(CLASSES):
        np.cumsum(kind == c, out=total[1:])
        own[:, c] = (total[end] - total[start]) / size
    w = textvec.words(data, at)
    word = np.searchsorted(w.start, np.stack([start, end]))
    n = word[1] - word[0]
    h = textvec.word_hashes(w)
    again = np.zeros(len(h) + 1, np.int64)
    np.cumsum(h[1:] == h[:-1], out=again[2:]) if len(h) > 1 else None
    own[:, CLASSES] = np.minimum((1 - own[:, 8]) * size / np.maximum(n, 1), 40) / 10
    own[:, CLASSES + 1] = np.log1p(n)
    own[:, CLASSES + 2] = n == 0
    own[:, CLASSES + 3] = (again[word[1]] - again[np.minimum(word[0] + 1, word[1])]) / np.maximum(n - 1, 1)
    begins = np.ones(len(start), dtype=bool)
    begins[1:] = last[:-1]
    x = np.zeros((len(start), WIDTH))
    x[:, :OWN] = own
    x[1:, OWN:2 * OWN] = own[:-1] * ~begins[1:, None]
    x[:-1, 2 * OWN:3 * OWN] = own[1:] * ~last[:-1, None]
    x[:, -3], x[:, -2], x[:, -1] = begins, last, 1
    return x, size.astype(np.float64), first


def _through(x: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log-odds after a transition, from log-odds before it."""
    return np.logaddexp(x + move[1, 1], move[0, 1]) - np.logaddexp(x + move[1, 0], move[0, 0])


def messages(unary: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (own line included) and backward log-odds (own line excluded) of every line."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    ahead, back = unary.copy(), np.zeros(len(unary))
    for t in range(1, int(n.max(initial=0))):
        at = start[:np.searchsorted(-n, -t, side="left")] + t
        ahead[at] = unary[at] + _through(ahead[at - 1], move)
    for t in range(int(n.max(initial=0)) - 2, -1, -1):
        at = start[:np.searchsorted(-n, -t - 1, side="left")] + t
        back[at] = _through(unary[at + 1] + back[at + 1], move.T)
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def marginals(model: Model, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(line is good | all lines of its text)."""
    ahead, back = messages(((x - model.mean) / model.scale) @ model.weight, first, model.move)
    return _sigmoid(ahead + back)


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximum penalised likelihood by full-batch Adam; ``y`` holds the label of every line."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    s = (x - mean) / scale
    inner = np.ones(len(x), dtype=bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        move = theta[-4:].reshape(2, 2)
        unary = s @ theta[:-4]
        ahead, back = messages(unary, first, move)
        a, b = ahead[to - 1], unary[to] + back[to]
        both = np.stack([np.full(len(to), move[0, 0]), move[0, 1] + b, move[1, 0] + a, move[1, 1] + a + b])
        both = np.exp(both - np.logaddexp.reduce(both, axis=0))
        g = np.concatenate([s.T @ (y - _sigmoid(ahead + back)), seen.ravel() - both.sum(axis=1)]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def untrained() -> Model:
    return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, sample: int = 6_000,
          text: str = "text", doc_id: str = "doc_id", **options) -> Model:
    """Fits on labelled rows outside the held-out fold (runs jobs)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in textvec.slices(batch.column("text")):
                x, _, first = observe(data, at)
                rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i),
                                                  pa.array(rows, pa.binary())], ["doc_id", "label", "lines"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, np.float32).reshape(-1, WIDTH), y) for batch in batches
                for x, y in zip(batch.column("lines").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        if rows:
            size = [len(x) for x, _ in rows]
            model = fit(np.concatenate([x for x, _ in rows]).astype(np.float64), np.repeat([int(y > 0) for _, y in rows], size),
                        np.concatenate([[0], np.cumsum(size)]), **options)
            yield pa.RecordBatch.from_arrays([pa.array([p.ravel().tolist()]) for p in model], ["mean", "scale", "weight", "move"])

    rows = training_rows(docs, labels, label, folds, held_out, sample, text, doc_id)
    ordered = rows.mapInArrow(lines, "doc_id long, label int, lines binary").repartition(1).sortWithinPartitions("doc_id", "lines")
    made = ordered.mapInArrow(learn, ", ".join(f"{p} array<double>" for p in Model._fields)).first()
    if made is None:
        return untrained()
    return Model(*(np.array(made[p]) for p in Model._fields[:3]), np.array(made.move).reshape(2, 2))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the length-weighted mean of the lines' marginals as a double."""

    @F.arrow_udf(T.DoubleType())
    def mean_marginal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [np.zeros(0)]
            for _, _, data, at in textvec.slices(column):
                x, size, first = observe(data, at)
                good = marginals(model, x, first)
                parts.append(np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1]))
            yield pa.array(np.clip(np.concatenate(parts), 0.0, 1.0))

    return docs.withColumn(out, mean_marginal(F.col(text)))
