"""Hidden Markov language model: latent states over word classes, words by their corpus counts.

Model. A text is a walk over ``states`` latent states; a state emits a word class (one of ``CLASSES`` hash
classes, and one for the end of a text), and a class emits its words by their training counts plus one, with
one count left over for all unknown words. So P(text) = P(classes | chain) * prod P(word | class), exact by
the scaled forward recursion; it sums to one over texts up to hash collisions of 64-bit word keys.

Training. Word counts are summed by Spark over the whole training part; the classes of all training tokens are written
once as 16-bit numbers. Every Baum-Welch round runs over all of them, from random emissions and states that seldom change:
each task sums the expected counts of its texts into one row, ``SUMS`` tasks add those up row by row, the driver
normalises some ``states * CLASSES`` numbers. From the second round on the step from the old to the new probabilities
is lengthened (``stride``, on the logarithms; back to the plain step after a round that lost likelihood), which takes about
half the rounds. Training ends when a round gains less than ``gain`` log10 likelihood a token, or after ``rounds``.

Scoring. Counts of the ``HEAD`` commonest words (a fixed number) are broadcast; rarer words of a text are
joined with the count table by hash, so nothing that grows with the vocabulary leaves the cluster, and no
common word makes a hot key. Texts are walked side by side; what long texts have beyond the others is cut into segments
whose transfer matrices are multiplied, so that one very long text costs no more per word than many short ones.

Cases. Null and empty texts are the end token alone. Without training texts every probability is uniform over
one unknown word: base scores are 0 and states are equal. Repeated rows are scored alike, and each training
row counts. Null ids count as the empty id text for the fold.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitframe.llm import textvec
from gaitframe.llm.labels import fold
from gaitframe.session import materialize

CLASSES = 4096
HEAD = 1 << 17
SEGMENT = 128
ACTIVE = 128
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_SHIFT = np.uint64(52)
_SLICE = 8 << 20
_COUNTED = 2_000_000
SUMS = 16


class Chain(NamedTuple):
    """Start, transition and emission probabilities of the latent states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def random_chain(states: int, seed: int = 5) -> Chain:
    rng = np.random.default_rng(seed)
    emit = rng.random((states, CLASSES + 1)) + 0.02
    move = rng.random((states, states)) + 300 * np.eye(states)
    return Chain(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by the end token, and the first token of each text."""
    w = textvec.words(data, at)
    first = w.first + np.arange(len(w.first))
    h = np.full(len(w.start) + len(at) - 1, END)
    inner = np.ones(len(h), dtype=bool)
    inner[first[1:] - 1] = False
    h[inner] = textvec.word_hashes(w)
    return h, first


def classes(h: np.ndarray) -> np.ndarray:
    return np.where(h == END, CLASSES, (h >> _SHIFT).astype(np.int64))


class _Pieces(NamedTuple):
    """Runs of tokens, the longest first, laid out step by step: the tokens of step ``t`` are ``at[t]:at[t + 1]``."""

    text: np.ndarray
    rank: np.ndarray
    token: np.ndarray
    at: np.ndarray


def _pieces(start: np.ndarray, size: np.ndarray, text: np.ndarray, rank: np.ndarray) -> _Pieces:
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    at = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    step = np.repeat(np.arange(len(active)), active)
    return _Pieces(text[order], rank[order], start[np.arange(at[-1]) - at[step]] + step, at)


def _cut(first: np.ndarray, segment: int) -> tuple[_Pieces, _Pieces]:
    """The heads of all texts, and what long texts have beyond them in runs of ``segment`` tokens.

    Heads end where fewer than ``ACTIVE`` texts go on, so that a step is never a few texts wide."""
    size = np.diff(first)
    some = np.sort(size)[-min(ACTIVE, len(size)):][:1]
    length = max(segment, int(some[0]) if len(size) >= ACTIVE else 0)
    head = np.minimum(size, length)
    n = -(-(size - head) // segment)
    text = np.repeat(np.arange(len(size)), n)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = first[:-1][text] + length + rank * segment
    every = np.arange(len(size))
    return _pieces(first[:-1], head, every, np.zeros(len(size), np.int64)), _pieces(start, np.minimum(segment, first[text + 1] - start), text, rank)


def _transfers(seen: np.ndarray, p: _Pieces, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Scaled transfer matrix of each piece and the logarithm of its scale."""
    k, n = len(chain.start), len(p.text)
    product, scale = np.tile(np.eye(k), (n, 1, 1)), np.zeros(n)
    for t in range(len(p.at) - 1):
        m = p.at[t + 1] - p.at[t]
        step = (product[:m].reshape(-1, k) @ chain.move).reshape(m, k, k) * seen[p.at[t]:p.at[t + 1], None, :]
        if t % 8 == 7 or t == 0:
            top = step.max(axis=(1, 2))
            step /= top[:, None, None]
            scale[:m] += np.log(top)
        product[:m] = step
    return product, scale


def _forward(seen: np.ndarray, p: _Pieces, now: np.ndarray, chain: Chain, starts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors and scales of all tokens; ``now`` becomes the state distribution after each piece."""
    ahead, scale = np.empty_like(seen), np.empty(len(seen))
    for t in range(len(p.at) - 1):
        a, b = p.at[t], p.at[t + 1]
        step = (now[:b - a] if starts and not t else now[:b - a] @ chain.move) * seen[a:b]
        total = step.sum(axis=1)
        step /= total[:, None]
        ahead[a:b], scale[a:b], now[:b - a] = step, total, step
    return ahead, scale


def _backward(seen: np.ndarray, p: _Pieces, ahead: np.ndarray, scale: np.ndarray, before: np.ndarray | None, back: np.ndarray,
              chain: Chain) -> np.ndarray:
    """Expected moves; ``ahead`` becomes the state probabilities of the tokens (the scales make them sum to one)."""
    moves, inverse = np.zeros_like(chain.move), 1 / scale[:, None]
    for t in range(len(p.at) - 2, -1, -1):
        a, b = p.at[t], p.at[t + 1]
        onward = seen[a:b] * back[:b - a] * inverse[a:b]
        ahead[a:b] *= back[:b - a]
        last = ahead[p.at[t - 1]:p.at[t - 1] + b - a] if t else before
        if last is not None:
            moves += last[:b - a].T @ onward
            back[:b - a] = onward @ chain.move.T
    return moves * chain.move


class _Ahead(NamedTuple):
    """The forward pass of a run of texts: heads and tails with the probabilities of what is seen, and scales."""

    log: np.ndarray
    heads: tuple
    tails: tuple | None


def _ahead(c: np.ndarray, first: np.ndarray, chain: Chain, segment: int) -> _Ahead:
    heads, tails = _cut(first, segment)
    emit, k, n = np.ascontiguousarray(chain.emit.T), len(chain.start), len(first) - 1
    seen, now = emit[c[heads.token]], np.tile(chain.start, (n, 1))
    ahead, scale = _forward(seen, heads, now, chain, True)
    step = np.repeat(np.arange(len(heads.at) - 1), np.diff(heads.at))
    log = np.bincount(heads.text[np.arange(len(scale)) - heads.at[step]], weights=np.log(scale), minlength=n)
    if not len(tails.text):
        return _Ahead(log, (heads, seen, ahead, scale, now), None)
    here = np.empty((n, k))
    here[heads.text] = now
    tail_seen = emit[c[tails.token]]
    product, more = _transfers(tail_seen, tails, chain)
    before, by = np.empty((len(tails.text), k)), np.argsort(tails.rank, kind="stable")
    cut = np.searchsorted(tails.rank[by], np.arange(int(tails.rank.max()) + 2))
    ranks = [by[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for some in ranks:
        text = tails.text[some]
        before[some] = here[text]
        moved = np.einsum("si,sij->sj", here[text], product[some])
        total = moved.sum(axis=1)
        log[text] += np.log(total) + more[some]
        here[text] = moved / total[:, None]
    return _Ahead(log, (heads, seen, ahead, scale, now), (tails, tail_seen, product, before, ranks))


def log_likelihood(c: np.ndarray, first: np.ndarray, chain: Chain, segment: int = SEGMENT) -> np.ndarray:
    """Natural log-likelihood of the class sequence of each text."""
    return _ahead(c, first, chain, segment).log


def expected_counts(c: np.ndarray, first: np.ndarray, chain: Chain, segment: int = SEGMENT) -> tuple[Chain, float]:
    """Expected starts, moves and emissions over the texts, and their log-likelihood (the exact E-step)."""
    k, n = len(chain.start), len(first) - 1
    log, (heads, seen, ahead, scale, now), rest = _ahead(c, first, chain, segment)
    moves, beyond, parts = np.zeros((k, k)), np.ones((n, k)), []
    if rest is not None:
        tails, tail_seen, product, before, ranks = rest
        after, out = np.empty_like(before), before.copy()
        tail_ahead, tail_scale = _forward(tail_seen, tails, out, chain, False)
        for some in reversed(ranks):
            text = tails.text[some]
            after[some] = beyond[text]
            pulled = np.einsum("sij,sj->si", product[some], beyond[text])
            beyond[text] = pulled / pulled.max(axis=1, keepdims=True)
        after /= np.einsum("si,si->s", out, after)[:, None]
        moves += _backward(tail_seen, tails, tail_ahead, tail_scale, before, after, chain)
        parts.append((c[tails.token], tail_ahead))
    after = beyond[heads.text]
    after /= np.einsum("si,si->s", now, after)[:, None]
    moves += _backward(seen, heads, ahead, scale, None, after, chain)
    parts.append((c[heads.token], ahead))
    emits = np.zeros((k, CLASSES + 1))
    for of, gamma in parts:
        for i in range(k):
            emits[i] += np.bincount(of, weights=gamma[:, i], minlength=CLASSES + 1)
    return Chain(ahead[:n].sum(axis=0), moves, emits), float(log.sum())


def maximise(counts: Chain, prior: float = 0.1) -> Chain:
    """Probabilities from expected counts, with a small count added to every slot."""
    return Chain(*((p + prior) / (p + prior).sum(axis=-1, keepdims=True) for p in counts))


class Model(NamedTuple):
    """Chain, count and vocabulary of each class, and the count table (hash ``h``, count ``c``)."""

    chain: Chain
    class_tokens: np.ndarray
    class_words: np.ndarray
    counts: DataFrame


def _text_batches(batches: Iterator[pa.RecordBatch], limit: int = _SLICE):
    for batch in batches:
        for i, j, data, at in textvec.slices(batch.column("text"), limit):
            h, first = tokens(data, at)
            yield batch, i, j, h, first


def word_counts(texts: DataFrame) -> DataFrame:
    """``h, c``: occurrences of every word (and of the end) in column ``text``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, _, h, _ in _text_batches(batches):
            some, n = np.unique(h, return_counts=True)
            both, place = np.unique(np.concatenate([keys, some]), return_inverse=True)
            keys, counts = both, np.bincount(place, weights=np.concatenate([counts, n])).astype(np.int64)
            if len(keys) > _COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])

    return texts.select("text").mapInArrow(partial, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def packed_classes(texts: DataFrame) -> DataFrame:
    """``classes``: the token classes of every text as 16-bit numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, h, first in _text_batches(batches):
            data = classes(h).astype("<u2").tobytes()
            offsets = pa.array(2 * first.astype(np.int64)).buffers()[1]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), j - i, [None, offsets, pa.py_buffer(data)]).cast(pa.binary())], ["classes"])

    return texts.select("text").mapInArrow(pack, "classes binary")


def _baum_welch(packed: DataFrame, chain: Chain) -> tuple[Chain, float]:
    """Expected counts over all texts and their log-likelihood: a row per task, added up by ``SUMS`` tasks."""
    shapes = [p.shape for p in chain]
    size = sum(int(np.prod(s)) for s in shapes) + 1

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i, j, data, at in textvec.slices(batch.column("classes"), _SLICE // 4):
                counts, log = expected_counts(data.view("<u2").astype(np.int64), at // 2, chain)
                total += np.concatenate([*(p.ravel() for p in counts), [log]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()])], ["place", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for row in batch.column("sums"):
                total, some = total + np.frombuffer(row.as_py()), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    sums = packed.mapInArrow(expect, "place int, sums binary").repartition(SUMS, "place").select("sums").mapInArrow(add, "sums binary").collect()
    flat = np.sum([np.frombuffer(r.sums) for r in sums], axis=0)
    cut = np.cumsum([int(np.prod(s)) for s in shapes])
    return Chain(*(p.reshape(s) for p, s in zip(np.split(flat[:-1], cut[:-1]), shapes, strict=True))), float(flat[-1])


def _lengthened(old: Chain, new: Chain, stride: float) -> Chain:
    far = Chain(*(o * (n / o) ** stride for o, n in zip(old, new, strict=True)))
    return Chain(*(p / p.sum(axis=-1, keepdims=True) for p in far))


def train(df: DataFrame, states: int = 6, rounds: int = 12, gain: float = 0.005, stride: float = 1.7, text: str = "text") -> Model:
    """Fits on every row of ``df`` (runs jobs; the count table and the packed classes are written tables)."""
    texts = df.select(F.col(text).alias("text"))
    counts = materialize(word_counts(texts), "words")
    ends = F.col("h") == int(END)
    of = F.when(ends, F.lit(CLASSES)).otherwise(F.call_function("shiftrightunsigned", F.col("h"), F.lit(int(_SHIFT))).cast("int"))
    n, v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in counts.groupBy(of.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r.k], v[r.k] = r.n, r.v
    chain, last = random_chain(states), -np.inf
    packed = materialize(packed_classes(texts), "classes") if n.sum() else None
    for step in range(rounds if n.sum() else 0):
        sums, log = _baum_welch(packed, chain)
        better = log / np.log(10) / n.sum() - last
        last = log / np.log(10) / n.sum()
        new = maximise(sums)
        chain = _lengthened(chain, new, stride) if step and better > 0 else new
        if 0 <= better < gain:
            break
    return Model(chain, n, v, counts)


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The commonest words, at most ``HEAD``: those above a count found from a histogram of count sizes."""
    step = F.floor(16 * F.log2("c")).cast("int")
    sizes = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for s, n in sizes:
        if held + n > HEAD:
            break
        least, held = s, held + n
    rows = counts.filter(step >= least).toArrow()
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order], least


def score(df: DataFrame, model: Model, text: str = "text", held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row (runs jobs).

    ``base_score`` is the add-one unigram score of the same counts, ``score`` the log10 likelihood of the model.
    """
    spark = df.sparkSession
    head, known, least = _head(model.counts)
    n, v = int(model.class_tokens.sum()), int(model.class_words.sum())
    own = np.log10(model.class_tokens + model.class_words + 1)
    shared = spark.sparkContext.broadcast((tuple(model.chain), own, head, np.log10(known + 1.0)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, own, head, gain = shared.value
        chain = Chain(*chain)
        for batch, i, j, h, first in _text_batches(batches):
            c, text_of = classes(h), np.repeat(np.arange(j - i), np.diff(first))
            likelihood = log_likelihood(c, first, chain) / np.log(10) - np.bincount(text_of, weights=own[c], minlength=j - i)
            place = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
            hit = head[place] == h if len(head) else np.zeros(len(h), dtype=bool)
            sums = np.bincount(text_of[hit], weights=gain[place[hit]], minlength=j - i).astype(np.float64)
            rest, rest_text = h[~hit], text_of[~hit]
            cut = np.searchsorted(rest_text, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i),
                 pa.array(np.diff(first)), pa.array(np.bincount(text_of[hit], minlength=j - i)), pa.array(sums), pa.array(likelihood),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(rest.view(np.int64)))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "sums", "likelihood", "rest"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.lit(None) if held_out is None else held_out).cast("boolean").alias("held_out"),
                     F.col(text).alias("text"))
    kind = dict(df.dtypes)["doc_id"]
    weighed = materialize(rows.mapInArrow(weigh, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, "
                                                 "likelihood double, rest array<long>"), "weighed")
    step = F.floor(16 * F.log2("c")).cast("int")
    rare = weighed.select("row", F.explode("rest").alias("h"))
    found = rare.join(model.counts.filter(step < least), "h").groupBy("row").agg(
        F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    gained = F.col("sums") + F.coalesce("more", F.lit(0.0))
    return weighed.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (gained - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"), (gained + F.col("likelihood")).alias("score"))


def score_documents(df: DataFrame, folds: int = 7, held_out: int = 2, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Trains outside the held-out fold of crc32(id) and scores every row."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = fold(F.col("doc_id"), folds) == held_out
    return score(docs, train(docs.filter(~out), **options), held_out=out)
