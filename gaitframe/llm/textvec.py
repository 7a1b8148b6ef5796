"""Text columns as numpy arrays: word spans and word hashes of whole Arrow batches, without per-word Python.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes with A-Z lower-cased, or with ``blank=NO_TERM`` the runs of
letters, digits and characters beyond ASCII. Null texts are empty.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_TERM = np.ones(256, dtype=bool)
NO_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Words(NamedTuple):
    """Words of a run of texts; ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0] if len(at) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes at most, one row at least: (from, to, bytes, offsets)."""
    data, at = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, blank: np.ndarray = SPACE) -> Words:
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    data = LOWER[data]
    inside = ~blank[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, kept while a worker needs them. They never travel: what is sent
    to a worker begins empty."""

    def __init__(self):
        self.held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.held[0]) < n:
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n, BATCH_BYTES + 4096), base & _MASK, dtype=np.uint64)
                steps[0] = 1
                self.held[i] = np.cumprod(steps, dtype=np.uint64)
        return self.held

    def trim(self) -> None:
        if len(self.held[0]) > 4 * BATCH_BYTES:
            self.__init__()


_POWERS = _Powers()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = BATCH_BYTES) -> np.ndarray:
    """64-bit hash of the bytes of each span (spans in order, not overlapping): a polynomial over all bytes
    at once, taken from running sums, so that it costs a few array operations and no loop over spans."""
    out = np.zeros(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _POWERS.upto(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    _POWERS.trim()
    return out


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(w.data, w.start, w.end)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` hashes that begin at each place (places whose gram would pass the end are left out)."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x100000001B3) + h[i:i + size])
    return out


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Place of each hash in a table of ``2 ** bits`` marks."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)
