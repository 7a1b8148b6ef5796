"""SimHash near duplicates: fingerprints of word shingles, linked at a few differing bits.

Method (deletion variants). A fingerprint is cut into segments so few that one of them differs by at most
one bit (``max_bits // 2 + 1``). Every bit of a segment is wildcarded in turn; equal variants meet in one
sorted run and are verified by the whole distance. A pair is emitted only by the first variant it shares.

Sixty-four bits linked at four find copies with a word or two changed. Differing bits do not tell a similarity of
0.8 of the shingle sets from one of 0.7, so with ``similarity`` (``SIMILAR``) documents are linked by the exact
Jaccard similarity of their sets, and the candidates come from MinHash bands: see :mod:`gaitframe.llm.similar`.

Scale. Equal texts are one fingerprint from the start, so a group of copies is one row. Runs of up to
``RUN`` fingerprints are compared in arrays and emit a spanning set of links, never all pairs. A longer run
is passed on and cut into blocks; every pair of blocks is a small group of its own (``RUN`` rows of each),
so no task holds a run, and no link is lost.

Cases. Fewer words than a shingle: the whole sequence is one shingle. Null, empty and blank texts have
fingerprint zero and are linked like any other. Every row is returned, repeated ids included; a null id never
names a component (a component of null ids alone is null). ``fingerprints`` keeps all other columns.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.llm import similar
from gaitframe.llm.components import connected_components
from gaitframe.llm.textvec import mix
from gaitframe.session import materialize

WORD = 64
RUN = 4096
SHORT = 32
DENSE = 512
#: Pairs with a similarity of 0.8 or more of their five-word shingle sets.
SIMILAR = {"shingle": 5, "similarity": 0.8}
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, in order and with repeats."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(tokens), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end, k = np.cumsum(size + 1) - 1, min(shingle, len(tokens))
    start, stop = (end - size).tolist(), end[k - 1:].tolist()
    return np.fromiter((hashed(joined[s:e], 42) for s, e in zip(start, stop, strict=False)), np.uint64, len(stop))


def majority(hashes: np.ndarray, bits: int = WORD) -> list[int]:
    """Majority bits over all hashes, as signed longs: first those of the hashes, then those of mixtures of them
    where more than 64 bits are asked for."""
    if not len(hashes):
        return [0] * (bits // WORD)
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        h = hashes[i:i + _BLOCK]
        wide = np.stack([h] + [mix(h + np.uint64(j)) for j in range(1, bits // WORD)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64).tolist()


def fingerprint(text: str | None, shingle: int = 4, bits: int = WORD) -> list[int]:
    """Majority bits over all word shingles."""
    return majority(shingle_hashes(text, shingle), bits)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 4, bits: int = WORD) -> DataFrame:
    """Adds the fingerprint as an array of longs."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle, bits) for t in column], pa.list_(pa.int64()))

    return df.withColumn(out, of(F.col(text)))


def as_hex(word: "F.Column") -> "F.Column":
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def _cuts(bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(word, offset in it, width) of the segments; none crosses a word."""
    each, out = -(-segments // (bits // WORD)), []
    for word in range(bits // WORD):
        at = [round(WORD * i / each) for i in range(each + 1)]
        out += [(word, a, b - a) for a, b in zip(at, at[1:], strict=False)]
    return out


def _variants(fps: DataFrame, bits: int, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each wildcarded bit: the low bits of ``key`` are its place, the others hash the rest of its segment."""
    p, part, off, width = F.col("p"), F.lit(0).cast("long"), F.lit(0), F.lit(0)
    for word, a, w in cuts:
        here = p >= word * WORD + a
        part = F.when(here, F.col(f"f{word}")).otherwise(part)
        off, width = F.when(here, F.lit(a)).otherwise(off), F.when(here, F.lit(w)).otherwise(width)
    one = F.lit(1).cast("long")
    segment = F.call_function("shiftrightunsigned", part, off).bitwiseAND(F.call_function("shiftleft", one, width) - 1)
    rest = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, p % WORD - off)))
    key = F.xxhash64(rest).bitwiseAND(F.lit(-bits)).bitwiseOR(p.cast("long"))
    return fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("p")).select(key.alias("key"), *fps.columns)


def _distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _first_variant(x: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """Place of the first wildcard under which two fingerprints of difference ``x`` are equal."""
    first = np.full(len(x), -1, np.int64)
    for word, a, w in cuts:
        part = (x[:, word] >> np.uint64(a)) & np.uint64((1 << w) - 1)
        low = np.where(part > 0, np.log2(np.maximum(part, 1).astype(np.float64)).astype(np.int64), 0)
        first = np.where((first < 0) & (np.bitwise_count(part) <= 1), word * WORD + a + low, first)
    return first


def _spanning(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect what is connected within one run: each member meets those not reached yet."""
    none = np.zeros(0, np.int64)
    if len(fps) <= DENSE:
        i, j = np.nonzero(np.triu(_distance(fps[:, None] ^ fps[None, :]) <= max_bits, 1))
        if len(i) <= 4 * len(fps):
            return i, j
    a, b, left = [none], [none], np.arange(len(fps))
    while len(left):
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            x = ahead.pop()
            near = _distance(fps[left] ^ fps[x]) <= max_bits
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                ahead.extend(hit)
    return np.concatenate(a), np.concatenate(b)


def _links_of_runs(bits: int, cuts: list[tuple[int, int, int]], max_bits: int, longest: int | None):
    """mapInArrow over rows sorted by key: links, and the rows of runs longer than ``longest``."""
    k = bits // WORD

    def rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        key = pa.nulls(n, pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays(
            [key, *(pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for x in (a, b) for i in range(k))],
            ["key", *(f"{x}{i}" for x in "ab" for i in range(k))])

    def compare(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links within the runs; those longer than the limit are passed on."""
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(cut)
        reach = np.repeat(np.where(size > SHORT, 0, cut[1:]), size)
        for lag in range(1, min(SHORT, int(size.max(initial=0)))):
            i = np.flatnonzero(np.arange(len(keys)) + lag < reach)
            x = fps[i] ^ fps[i + lag]
            i = i[near := x.any(axis=1) & (_distance(x) <= max_bits)]
            if longest is not None:
                i = i[(keys[i] & (bits - 1)) == _first_variant(x[near], cuts)]
            if len(i):
                yield rows(None, fps[i], fps[i + lag])
        for r in np.flatnonzero(size > SHORT):
            run = fps[cut[r]:cut[r + 1]]
            if longest is not None and len(run) > longest:
                yield rows(keys[cut[r]:cut[r + 1]], run, run)
                continue
            a, b = _spanning(run, max_bits)
            if len(a):
                yield rows(None, run[a], run[b])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, passing = np.zeros(0, np.int64), np.zeros((0, k), np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, np.stack([batch.column(f"f{i}").to_numpy().view(np.uint64) for i in range(k)], axis=1)])
            if passing is not None and len(keys):
                stop = int(np.searchsorted(keys, passing, side="right")) if keys[0] == passing else 0
                if stop:
                    yield rows(keys[:stop], fps[:stop], fps[:stop])
                    keys, fps = keys[stop:], fps[stop:]
                passing = None if len(keys) else passing
            if len(keys) < 1 << 16:
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last:
                yield from compare(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if longest is not None and len(keys) > longest:
                passing = keys[0]
                yield rows(keys, fps, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from compare(keys, fps)

    return over


def fingerprint_links(fps: DataFrame, max_bits: int = 4, bits: int = WORD, segments: int | None = None) -> DataFrame:
    """Links that span every component of distinct fingerprints (long columns ``f0`` ...) at ``max_bits``: columns
    ``a0 ... b0 ...``.

    Each link is a verified pair within ``max_bits``; within a long run only a spanning set is given. With the
    default number of segments no pair within ``max_bits`` is missed.
    """
    cuts, k = _cuts(bits, segments or max_bits // 2 + 1), bits // WORD
    ends = [f"{x}{i}" for x in "ab" for i in range(k)]
    schema = ", ".join(f"{c} long" for c in ["key", *ends])
    words = [f"f{i}" for i in range(k)]
    met = materialize(_variants(fps.select(*words), bits, cuts).repartition("key").sortWithinPartitions("key", "f0")
                      .mapInArrow(_links_of_runs(bits, cuts, max_bits, RUN), schema), "variants")
    hot = met.filter("key IS NOT NULL").select("key", *[F.col(f"a{i}").alias(f"f{i}") for i in range(k)])
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("n"))
    cut = hot.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64(*words), "n").cast("int")).select(
        "key", *words, "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = cut.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), *words)
    rest = pairs.repartition("key").sortWithinPartitions("key", "f0").mapInArrow(_links_of_runs(bits, cuts, max_bits, None), schema)
    return met.filter("key IS NULL").union(rest).select(*ends)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_bits: int = 4,
                    bits: int = WORD, segments: int | None = None, similarity: float | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document; the component is named by its smallest id.

    With ``similarity`` documents are linked where their shingle sets are as similar; no fingerprints are made then and
    the columns are ``doc_id, component_id``. Runs jobs (fingerprints and links are written tables).
    """
    if similarity is not None:
        return _similar_documents(df, text, doc_id, shingle, similarity)
    k = bits // WORD
    words = [f"f{i}" for i in range(k)]
    made = fingerprints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "f", shingle, bits)
    docs = materialize(made.select("doc_id", *[F.col("f")[i].alias(f"f{i}") for i in range(k)]), "fingerprints")
    fps = docs.groupBy(*words).agg(F.min("doc_id").alias("first"))

    def node(x: str) -> "F.Column":
        return F.col(f"{x}0") if k == 1 else F.xxhash64(*[f"{x}{i}" for i in range(k)])

    links = fingerprint_links(fps, max_bits, bits, segments)
    parts = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    fps = fps.withColumn("of", node("f"))
    named = fps.join(parts, fps["of"] == parts["node"], "left").select(*words, "first", F.coalesce("component", "of").alias("component"))
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    return docs.join(named.join(smallest, "component").select(*words, "component_id"), words).select(
        "doc_id", F.array(*words).alias("fingerprint"), "component_id")


def _similar_documents(df: DataFrame, text: str, doc_id: str, shingle: int, similarity: float) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array([similar.digest(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()),
                 pa.array([similar.strata(h) for h in sets], pa.binary()), pa.array([similar.bands(h) for h in sets], pa.list_(pa.int64()))],
                ["doc_id", "t", "node", "n", "strata", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.sort(h.view(np.int64)) for h in own], pa.list_(pa.int64()))], ["node", "held"])

    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("t", F.xxhash64("text"))
    docs = materialize(texts.mapInArrow(sketch, "doc_id long, t long, node long, n long, strata binary, bands array<long>"), "sketches")
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("t").alias("t"), F.any_value("n").alias("n"),
                                     F.any_value("strata").alias("strata"), F.any_value("bands").alias("bands"))
    nodes = materialize(nodes, "sets-by-node")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """One text of each wanted set, as its set."""
        one = materialize(nodes.select("node", "t").join(wanted, "node"), "wanted")
        found = texts.select("t", "text").join(one, "t").groupBy("node").agg(F.min("text").alias("text"))
        return found.mapInArrow(sets, "node long, held array<long>")

    parts = similar.similar_parts(nodes, sets_of, similarity)
    named = materialize(nodes.select("node", "first").join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "named")
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    of = materialize(named.join(smallest, "component").select("node", "component_id"), "components")
    return docs.join(of, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id.

    Rows with a null id stay. Of rows that repeat the kept id all stay, as the id names one document.
    """
    gone = near_duplicates(docs, text, doc_id, **options).filter("doc_id != component_id").select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def keep_first_linked(docs: DataFrame, parts: list[DataFrame], doc_id: str = "doc_id") -> DataFrame:
    """Like :func:`keep_first` for the groups that several results of :func:`near_duplicates` make together (runs jobs)."""
    links = None
    for part in parts:
        one = part.filter("doc_id != component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        links = one if links is None else links.unionByName(one)
    gone = connected_components(materialize(links, "both-links")).filter("node != component").select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
