"""Byte-level BPE: encode texts by a table of ranked merges, decode ids by concatenating their pieces.

Method. A text is cut by the tokenizer's pattern, each distinct piece is folded once per worker (the pair
of lowest rank, leftmost first, is merged until none is left) and its ids are reused for every occurrence. New pieces are
folded together: every round merges the best pair of each piece of a block in arrays (``Folds``).
Decoding is one JVM expression. The fold runs in an Arrow UDF: as a Spark higher-order function it is right
but far beyond the limits (figures in the README); ``fold_expression`` keeps that form for small inputs.

Cases. Null and empty texts give no ids, no ids decode to an empty binary, null ids to null; an id outside
the table is an error. Pieces of any length are folded in O(n log n). Other columns stay as they are.
"""

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_PIECES = 300_000
HEAP_FROM = 48
#: Characters of text that are cut and looked up at a time, and pieces whose merges go on together.
GROUP_CHARS, BLOCK_PIECES = 1_000_000, 4_096


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 piece and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > HEAP_FROM:
        return _fold_long(word, ranks)
    parts, get = [word[i:i + 1] for i in range(len(word))], ranks.get
    pairs = [get(x + y, _NONE) for x, y in zip(parts, parts[1:], strict=False)]
    while pairs and (low := min(pairs)) != _NONE:
        i = pairs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 60


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold over a linked list with a heap of pairs, for long runs without a break."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n + [False]
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Folds:
    """The fold of many pieces at a time. Pairs of ids that merge stand in a sorted array of their joint keys."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.base = ranks, max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        cuts = ((ranks.get(p[:i]), ranks.get(p[i:]), r) for p, r in ranks.items() for i in range(1, len(p)))
        found = sorted((x * self.base + y, r) for x, y, r in cuts if x is not None and y is not None)
        self.keys, self.merged = np.array([*(k for k, _ in found), _NONE], np.int64), np.array([*(r for _, r in found), _NONE], np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = np.where((x >= 0) & (y >= 0), x * self.base + y, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        ids: list = [None] * len(words)
        plain, whole = [], self.bytes.min() >= 0
        for i, word in enumerate(words):
            if word in self.ranks or len(word) > HEAP_FROM or not whole:
                ids[i] = fold(word, self.ranks)
            else:
                plain.append(i)
        plain.sort(key=lambda i: len(words[i]))
        for a in range(0, len(plain), BLOCK_PIECES):
            self._merge(words, plain[a:a + BLOCK_PIECES], ids)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts

    def _merge(self, words: list[bytes], at: list[int], ids: list) -> None:
        """Ids of a block of words; each round takes one pair from every word that still has one, so rows stay of one width."""
        sizes = np.array([len(words[i]) for i in at])
        parts = np.full((len(at), sizes.max()), -1, np.int64)
        parts[np.arange(sizes.max()) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(words[i] for i in at), np.uint8)]
        ranks, own = self.rank(parts[:, :-1], parts[:, 1:]), np.array(at)
        while len(own):
            rows = np.arange(len(own))
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            low = ranks[rows, best] if ranks.shape[1] else np.full(len(own), _NONE)
            live = low != _NONE
            if not live.all():
                for i, row in zip(own[~live].tolist(), parts[~live].tolist()):
                    ids[i] = row[:row.index(-1)] if row[-1] < 0 else row
                own, parts, ranks, best, low = own[live], parts[live], ranks[live], best[live], low[live]
                if not len(own):
                    return
                rows = np.arange(len(own))
            parts[rows, best] = low
            others, rest = np.ones(parts.shape, bool), np.ones(ranks.shape, bool)
            others[rows, best + 1] = rest[rows, best] = False
            parts, ranks = parts[others].reshape(len(own), -1), ranks[rest].reshape(len(own), ranks.shape[1] - 1)
            for left in (best - 1, best):
                some = np.flatnonzero((left >= 0) & (left < ranks.shape[1]))
                ranks[some, left[some]] = self.rank(parts[some, left[some]], parts[some, left[some] + 1])


class _Pieces:
    """Ids by piece, filled on demand; emptied when full, so that a worker's memory is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.folds = ranks, Folds(ranks)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, piece: str) -> np.ndarray:
        return self.encode([piece])[0]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        distinct = set(pieces)
        new = [p for p in distinct if p not in self.places]
        if len(self.places) + len(new) > CACHED_PIECES:
            self.clear()
            new = list(distinct)
        if new:
            ids, counts = self.folds([p.encode() for p in new])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


#: The pieces folded so far by this worker, over all its tasks.
_READY: list[_Pieces] = []


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids array<int>``: the ids of ``text``, each match of ``pattern`` encoded separately.

    The table of ranks travels as a broadcast variable; its size is that of the vocabulary file, whatever the data.
    """
    table = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not _READY or _READY[0].ranks is not table.value:
            _READY[:] = [_Pieces(table.value)]
        pieces, find = _READY[0], regex.compile(pattern).findall
        for column in batches:
            flat, sizes, found, chars = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
            for i, t in enumerate(column):
                text = t.as_py() or ""
                found.append(find(text))
                chars += len(text)
                if chars >= GROUP_CHARS or i + 1 == len(column):
                    some, counts = pieces.encode(list(chain.from_iterable(found)))
                    flat.append(some)
                    sizes.append(np.diff(np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(list(map(len, found)))]]))
                    found, chars = [], 0
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat)))

    return df.withColumn(ids, encoded(F.col(text)))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``decoded binary``: the pieces of ``ids`` one after the other, looked up in a literal array."""
    pieces = {rank: base64.b64encode(piece).decode() for piece, rank in ranks.items()}
    table = F.split(F.lit(" ".join(pieces.get(i, "-") for i in range(max(pieces) + 1))), " ")
    piece = F.transform(F.col(ids), lambda i: F.unbase64(F.element_at(table, i + 1)).cast("string"))
    return df.withColumn(out, F.array_join(piece, "").cast("binary"))


def fold_expression(piece: Column, ranks: dict[bytes, int], buckets: int = 8192) -> Column:
    """The fold as a higher-order expression: ids of a binary piece by merges over its array of hex bytes.

    The rank map is a pair of literal arrays with an equal number of slots for each hash bucket, so that a look-up
    reads one short slice (a literal map of this size would be searched from its start).
    """
    rows: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
    for p, r in ranks.items():
        text = p.hex().upper()
        rows[zlib.crc32(text.encode()) % buckets].append((text, r))
    slots = max(map(len, rows))
    keys = F.split(F.lit(",".join(",".join([t for t, _ in row] + ["-"] * (slots - len(row))) for row in rows)), ",")
    values = F.split(F.lit(",".join(",".join([str(r) for _, r in row] + ["0"] * (slots - len(row))) for row in rows)), ",").cast("array<int>")

    def rank(p: Column) -> Column:
        start = (F.pmod(F.crc32(p.cast("binary")), F.lit(buckets)) * slots).cast("int")
        place = F.array_position(F.slice(keys, start + 1, slots), p).cast("int")
        return F.when(place > 0, F.get(values, start + place - 1))

    text = F.hex(piece)
    letters = F.transform(F.sequence(F.lit(1), F.octet_length(piece)), lambda i: F.substring(text, i * 2 - 1, F.lit(2)))

    def merge(parts: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(
            rank(F.concat(F.get(parts, i - 1), F.get(parts, i))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(ranked, lambda x: x["r"].isNotNull()))
        joined = F.transform(F.array(best), lambda b: F.concat(
            F.slice(parts, 1, b["i"] - 1), F.array(F.concat(F.get(parts, b["i"] - 1), F.get(parts, b["i"]))), F.slice(parts, b["i"] + 2, F.size(parts))))[0]
        return F.coalesce(joined, parts)

    return F.transform(F.aggregate(F.sequence(F.lit(1), F.size(letters)), letters, merge), rank)
