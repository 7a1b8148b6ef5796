"""Benchmark decontamination: passages of documents within an edit bound of a benchmark item.

Method. Texts are words (A-Z lower-cased, all outer punctuation dropped; a word of
marks alone is its first mark). Windows of an item's length are
embedded by CGK random walks: reading symbol ``x`` at step ``j`` copies it to the output and a random bit of
(j, x) says whether the reader moves on, so a few edits leave most of the output equal. Tables of sampled
output positions (bit-sampling LSH) are repeated until a pair that agrees in ``agreement`` of the positions
is met with probability ``recall``. Every candidate is verified by the exact edit distance between the item
and the best passage around the window; ``1 - distance / words`` must reach ``similarity``.

Windows are not embedded where that can't matter: an item of n words with k allowed edits keeps a run of
``n // (k + 1)`` words (3 at most are used) intact, so a window that shares no such run at an offset within
reach of the item can't pass the bound. This is lossless; the candidates come from the LSH tables alone.

Scale. One pass over the documents with no shuffle. Item tables are broadcast in portions of at most
``portion_bytes`` of item text; more items mean more passes, not a larger broadcast.

Cases. Null or empty texts and items match nothing. Rows with equal ids are documents of their own. Items
with one id are items of their own. Ids may be null. Other columns are ignored.
"""

import math
from collections.abc import Iterator
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm import textvec

SCHEMA = "doc_id long, item_id long, distance int, similarity double, first_word int, last_word int"
PAD = np.uint64(0)
_SLICE = 4 << 20
_BLOCK = 4096
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (never the padding symbol) and the first word of each text."""
    w = textvec.words(data, at)
    kept = np.append(np.flatnonzero(~_PUNCTUATION[w.data]), len(w.data))
    start, end = kept[np.searchsorted(kept, w.start)], kept[np.searchsorted(kept, w.end) - 1] + 1
    marks = start >= w.end
    start, end = np.where(marks, w.start, start), np.where(marks, w.start + 1, end)
    return textvec.span_hashes(w.data, start, end) | np.uint64(1), w.first


class Tables(NamedTuple):
    """Number of walks, tables of each walk, positions of each table."""

    walks: int
    each: int
    positions: int


def tables_for(recall: float, agreement: float, positions: int = 3, walks: int = 4) -> Tables:
    need = math.ceil(math.log(1 - recall) / math.log(1 - agreement ** positions))
    return Tables(walks, math.ceil(need / walks), positions)


def signatures(h: np.ndarray, start: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, tables: Tables) -> np.ndarray:
    """LSH keys (window, table) of the windows ``h[start:start + n]``, padded outside ``low:high``.

    Each walk makes ``3 n`` output symbols; a table's positions are fixed fractions of that length.
    """
    out = np.zeros((len(start), tables.walks * tables.each), np.uint64)
    if not len(start):
        return out
    order = np.argsort(-n, kind="stable")
    start, n, low, high = start[order], n[order], low[order], high[order]
    stop, steps = np.minimum(start + n, high), 3 * n
    rows = np.arange(len(start))[:, None]
    for walk in range(tables.walks):
        fractions = np.random.default_rng([20240607, walk]).random(tables.each * tables.positions)
        salts = textvec.mix(np.arange(1, int(steps.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(walk << 32))
        at = np.sort((fractions[None, :] * steps[:, None]).astype(np.int32).reshape(len(start), tables.each, tables.positions), axis=2)
        walked = np.full((len(start), int(steps.max(initial=0))), PAD)
        place = start.copy()
        for j in range(walked.shape[1]):
            k = int(np.searchsorted(-steps, -j, side="left"))
            p = place[:k]
            inside = (p >= low[:k]) & (p < stop[:k])
            x = np.where(inside, h[np.where(inside, p, 0)], PAD)
            walked[:k, j] = x
            place[:k] += (((x ^ salts[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
        got = walked[rows, at.reshape(len(start), -1)].reshape(at.shape)
        key = np.broadcast_to((n.astype(np.uint64) * np.uint64(1000003) + np.uint64(walk))[:, None], at.shape[:2])
        for i in range(tables.positions):
            key = textvec.mix(key * np.uint64(0x100000001B3) + got[:, :, i])
        out[order, walk * tables.each:(walk + 1) * tables.each] = key + np.arange(tables.each, dtype=np.uint64)
    return out


def edit_ends(items: np.ndarray, sizes: np.ndarray, regions: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of each item to a passage of its region, and where that passage ends.

    ``items`` and ``regions`` are padded matrices. The passage begins anywhere, or at the region's first
    word if ``anchored``.
    """
    width = regions.shape[1]
    column = np.arange(width + 1, dtype=np.int32)
    row = np.tile(column if anchored else np.zeros_like(column), (len(items), 1))
    best = row.copy()
    for i in range(items.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != items[:, i:i + 1]), out=step[:, 1:])
        row = np.minimum.accumulate(step - column, axis=1) + column
        best = np.where((sizes > i)[:, None], row, best)
    end = best.argmin(axis=1)
    return best[np.arange(len(best)), end], end


class Items:
    """Symbols, seed runs and LSH tables of benchmark items."""

    def __init__(self, rows: list[tuple[int | None, str | None]], similarity: float, tables: Tables):
        raw = [(t or "").encode() for _, t in rows]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        self.h, first = symbols(data, at)
        self.start, self.n = first[:-1], np.diff(first)
        self.ids = [i for i, _ in rows]
        self.edits = np.floor((1 - similarity) * self.n + 1e-9).astype(np.int64)
        self.similarity, self.tables = similarity, tuple(tables)
        some = np.flatnonzero(self.n > 0)
        low = self.start[some]
        keys = signatures(self.h, low, self.n[some], low, low + self.n[some], tables)
        self.lsh = [(k[o := np.argsort(k)], some[o]) for k in keys.T]
        run = np.clip(self.n // (self.edits + 1), 1, 3)
        self.seeds = {}
        for q in np.unique(run[some]).tolist():
            grams, of = textvec.gram_hashes(self.h, q), np.repeat(np.arange(len(self.n)), self.n)
            offset = np.arange(len(self.h)) - np.repeat(self.start, self.n)
            ok = np.flatnonzero((run[of] == q) & (offset + q <= self.n[of]))
            ok = ok[np.argsort(grams[ok], kind="stable")]
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(grams[ok] >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[q] = (bits, grams[ok], of[ok], offset[ok])


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, index) with lo[row] <= index < hi[row]."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def candidates(h: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window start, item) of every window that shares an LSH key with an item."""
    windows = []
    for q, (bits, grams, of, offset) in items.seeds.items():
        g = textvec.gram_hashes(h, q)
        at = np.flatnonzero(bits[(g >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(grams, g[at], side="left"), np.searchsorted(grams, g[at], side="right")
        row, k = _spread(lo, hi)
        text = np.searchsorted(first, at[row], side="right") - 1
        inside = at[row] + q <= first[text + 1]
        windows.append(np.stack([text[inside], (at[row] - offset[k])[inside], items.n[of[k]][inside]], axis=1))
    windows = np.concatenate(windows) if windows else np.zeros((0, 3), np.int64)
    windows = np.unique(windows, axis=0)
    none = [np.zeros((0, 3), np.int64)]
    for i in range(0, len(windows), _BLOCK):
        text, start, n = windows[i:i + _BLOCK].T
        keys = signatures(h, start, n, first[text], first[text + 1], items.tables)
        for (known, item), key in zip(items.lsh, keys.T, strict=True):
            row, k = _spread(np.searchsorted(known, key, side="left"), np.searchsorted(known, key, side="right"))
            none.append(np.stack([text[row], start[row], item[k]], axis=1))
    return tuple(np.unique(np.concatenate(none), axis=0).T)


def _matrix(h: np.ndarray, lo: np.ndarray, n: np.ndarray, pad: int, back: bool = False) -> np.ndarray:
    j = np.arange(int(n.max(initial=0)))
    at = lo[:, None] + (n[:, None] - 1 - j if back else j)
    ok = j < n[:, None]
    return np.where(ok, h[np.where(ok, at, 0)], np.uint64(pad))


def verified(h: np.ndarray, first: np.ndarray, items: Items, text: np.ndarray, start: np.ndarray, item: np.ndarray):
    """The candidates within the bound: text, item, distance, first and last word of the passage."""
    found = []
    order = np.argsort(items.n[item], kind="stable")
    for i in range(0, len(order), _BLOCK):
        some = order[i:i + _BLOCK]
        t, it = text[some], item[some]
        n, k = items.n[it], items.edits[it]
        lo = np.clip(start[some] - k, first[t], first[t + 1])
        hi = np.clip(start[some] + n + k, lo, first[t + 1])
        pattern = _matrix(items.h, items.start[it], n, 0)
        d, end = edit_ends(pattern, n, _matrix(h, lo, hi - lo, 2))
        ok = np.flatnonzero(d <= k)
        if not len(ok):
            continue
        t, it, n, lo, end, d = t[ok], it[ok], n[ok], lo[ok], end[ok], d[ok]
        _, length = edit_ends(_matrix(items.h, items.start[it], n, 0, back=True), n, _matrix(h, lo, end, 2, back=True), anchored=True)
        found.append(np.stack([t, it, d, lo + end - length - first[t], lo + end - 1 - first[t]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 5), np.int64)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
                 item_id: str = "item_id", similarity: float = 0.8, recall: float = 0.98, agreement: float = 0.45,
                 portion_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and item with a passage within the bound: the closest passage (the first of
    several), its distance, similarity and word span. Reads the items to the driver in bounded portions."""
    named = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts, out = max(1, math.ceil(size / portion_bytes)), None
    tables = tables_for(recall, agreement)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for part in range(parts):
        rows = named.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()
        known = docs.sparkSession.sparkContext.broadcast(vars(Items([tuple(r) for r in rows], similarity, tables)))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            table = SimpleNamespace(**known.value)
            table.tables = Tables(*table.tables)
            for batch in batches:
                ids = batch.column("doc_id")
                for i, _, data, at in textvec.slices(batch.column("text"), _SLICE):
                    h, first = symbols(data, at)
                    if not len(h) or not len(table.n):
                        continue
                    hits = verified(h, first, table, *candidates(h, first, table))
                    hits = hits[np.lexsort((hits[:, 3], hits[:, 2], hits[:, 1], hits[:, 0]))]
                    new = np.ones(len(hits), dtype=bool)
                    new[1:] = (hits[1:, :2] != hits[:-1, :2]).any(axis=1)
                    t, it, d, a, b = hits[new].T
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(t + i)), pa.array([table.ids[x] for x in it], pa.int64()), pa.array(d.astype(np.int32)),
                         pa.array(1 - d / np.maximum(table.n[it], 1)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                        ["doc_id", "item_id", "distance", "similarity", "first_word", "last_word"])

        found = source.mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a passage of an item; rows with a null id stay."""
    gone = contaminated(docs, items, text, doc_id, **options).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
