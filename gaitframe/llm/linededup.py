"""Line dedup by winnowing: passages of whole lines that occurred earlier are deleted.

Method. Lines are hashed (outer blanks dropped; blank lines do not count). A window is a shortest run of lines with
``min_words`` words, forwards from a line or backwards from it; any run with so many words is made up of windows. A gram
is the shortest run from a line with ``gram_words`` words; of the grams inside a window the one with the smallest hash
is selected (winnowing), so equal windows select equal grams, and a repeated run holds a repeated selected gram.
Positions are joined on selected grams first; where one occurs more than once, the match is extended both ways: the
windows around it are joined, each as a whole, with the first place at which it occurred. Every window that has
an earlier place is deleted, and windows that overlap or touch make one run. So a line goes exactly if it belongs to
some run of ``min_words`` words that stands, line after line, at one earlier place. "Earlier" is by (id, hash of the
text, line), so the first copy stays; a run may overlap its earlier copy.

Scale. What is shuffled first is a row per selected gram, its windows as one array; windows of grams that occur once
(most texts) go no further. Counts and first places are combined aggregates and are written before they are joined back by
a join that Spark may split, so a line in every document is never one group.

Cases. Null texts stay null, empty ones empty; a text deleted whole becomes empty, its row stays. Rows equal
in id and text are one document and treated alike; null ids come last in the order. All other columns stay.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitframe.llm import textvec
from gaitframe.session import materialize

_NULL_LAST = (1 << 63) - 1


class Lines:
    """Lines with words of a run of texts: bytes, hash, number of words, line number, text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        w = textvec.words(data, at)
        text = w.text_of_word()
        breaks = np.flatnonzero(data == 10)
        row = np.searchsorted(breaks, w.start)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[:len(first)] - 1
        self.text, self.words = text[first], last - first + 1
        self.number = row[first] - np.searchsorted(breaks, at)[self.text]
        self.hash = textvec.span_hashes(data, w.start[first], w.end[last])
        stop = np.searchsorted(self.text, np.arange(len(at)), side="left")
        self.begin, self.stop = stop[self.text], stop[self.text + 1]
        self.total = np.concatenate([[0], np.cumsum(self.words)])

    def run_to(self, words: int) -> np.ndarray:
        """Last line of the shortest run from each line with so many words; -1 if its text ends before."""
        last = np.searchsorted(self.total, self.total[:-1] + words, side="left") - 1
        return np.where(last < self.stop, last, -1)

    def run_from(self, words: int) -> np.ndarray:
        """First line of the shortest run up to each line with so many words; -1 if its text begins after."""
        first = np.searchsorted(self.total, self.total[1:] - words, side="right") - 1
        return np.where(first >= self.begin, first, -1)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of each run of lines."""
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        powers, inverse = _powers(len(self.hash))
        np.cumsum(self.hash * powers, out=sums[1:])
        return textvec.mix((sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, out = 0xD6E8FEB86659FD93, []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def windows(lines: Lines, gram_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last line of every window, and the smallest hash of the grams inside it."""
    ahead, back = lines.run_to(min_words), lines.run_from(min_words)
    begin, end = np.flatnonzero(ahead >= 0), np.flatnonzero(back >= 0)
    runs = np.stack([np.concatenate([begin, back[end]]), np.concatenate([ahead[begin], end])], axis=1)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (runs[1:] != runs[:-1]).any(axis=1))[:len(runs)]]
    if not len(runs):
        return runs[:, 0], runs[:, 1], np.zeros(0, np.uint64)
    last = lines.run_to(gram_words)
    first = np.flatnonzero(last >= 0)
    grams = np.append(lines.hashes(first, last[first]), np.uint64(0))
    inside = np.stack([np.searchsorted(first, runs[:, 0]), np.searchsorted(last[first], runs[:, 1], side="right")], axis=1)
    return runs[:, 0], runs[:, 1], np.minimum.reduceat(grams, inside.ravel())[::2]


def _positions(gram_words: int, min_words: int):
    """A row per selected gram and neighbouring windows that select it: the windows' hashes, first and last lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            for i, _, data, at in textvec.slices(batch.column("text")):
                lines = Lines(data, at)
                first, last, grams = windows(lines, gram_words, min_words)
                text = lines.text[first]
                new = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]))[:len(first)])
                kinds = {"window": lines.hashes(first, last).view(np.int64), "first": lines.number[first].astype(np.int32), "last": lines.number[last].astype(np.int32)}
                held = pa.ListArray.from_arrays(pa.array(np.append(new, len(first)).astype(np.int32)), pa.StructArray.from_arrays([*map(pa.array, kinds.values())], list(kinds)))
                yield pa.RecordBatch.from_arrays([pa.array(grams[new].view(np.int64)), pa.array(doc[text[new] + i]), pa.array(mark[text[new] + i]), held],
                                                 ["gram", "doc", "mark", "windows"])

    return run


def _spans():
    """Deletes the given (first, last) lines of each text; those that overlap or touch are one run."""

    def of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        raw = text.encode("utf-8", "surrogatepass")
        lines = Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out = []
        for a, b in runs:
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        cut = np.searchsorted(lines.number, np.array(out) + [[0, 1]])
        return [(a, b, int(n)) for (a, b), n in zip(out, lines.total[cut[:, 1]] - lines.total[cut[:, 0]], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("n_words", pa.int32())]))
        for batch in batches:
            texts, spans = [], []
            for t, runs in zip(batch.column("_text").to_pylist(), batch.column("_runs").to_pylist(), strict=True):
                found = of(t, sorted({(r["first"], r["last"]) for r in runs})) if runs else []
                if found:
                    rows = t.split("\n")
                    for a, b, _ in reversed(found):
                        del rows[a:b + 1]
                    t = "\n".join(rows)
                texts.append(t)
                spans.append([{"first_line": a, "last_line": b, "n_words": w} for a, b, w in found])
            batch = batch.drop_columns(["_text", "_runs"])
            yield batch.append_column("_text", pa.array(texts, pa.string())).append_column("_spans", pa.array(spans, kind))

    return run


def repeated_windows(df: DataFrame, text: str, doc_id: str, gram_words: int, min_words: int) -> DataFrame:
    """``doc, mark, runs``: first and last lines of the windows that occurred earlier."""
    keyed = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_LAST)).alias("doc"),
                      F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")).filter("text != ''")
    kind = "gram long, doc long, mark long, windows array<struct<window:long,first:int,last:int>>"
    places = materialize(keyed.mapInArrow(_positions(gram_words, min_words), kind), "grams")
    several = materialize(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    around = places.join(several, "gram").select("doc", "mark", F.explode("windows").alias("w"))
    around = materialize(around.select("w.window", "doc", "mark", "w.first", "w.last"), "windows")
    place = F.struct("doc", "mark", "first")
    earliest = around.groupBy("window").agg(F.min(place).alias("earliest"), F.max(place).alias("latest"))
    earliest = materialize(earliest.filter("earliest != latest").select("window", "earliest"), "first-places")
    later = around.join(earliest, "window").filter(place != F.col("earliest"))
    return later.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def drop_repeated_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", gram_words: int = 25, min_words: int = 50,
                        spans: str | None = None) -> DataFrame:
    """``df`` with repeated passages deleted from ``text``; ``spans`` names a column for the deleted runs
    (first and last line of the given text, words). Runs a job (the positions are a written table)."""
    found = repeated_windows(df, text, doc_id, gram_words, min_words)
    found = found.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("runs").alias("_runs"))
    keyed = (F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_LAST)) == F.col("_doc")) & (F.xxhash64(F.col(text)) == F.col("_mark"))
    joined = df.join(found, keyed, "left").drop("_doc", "_mark")
    others = [f for f in df.schema.fields if f.name != text]
    wide = joined.select(*[F.col(f"`{f.name}`") for f in others], F.col(text).alias("_text"), "_runs")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    out = wide.mapInArrow(_spans(), ", ".join([*kinds, "_text string", "_spans array<struct<first_line:int,last_line:int,n_words:int>>"]))
    back = [F.col("_text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns]
    return out.select(*back, *([F.col("_spans").alias(spans)] if spans else []))
