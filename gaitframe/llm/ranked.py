"""Ranked lexical search: the highest-scoring documents of every query text, by MaxScore with pair bounds.

Method. Terms are the runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term of weight ``w``
(rarer is heavier) gives a document ``w * ((10^9 * tf) div (1000 * tf + 12 * m))``, ``m`` being the document's length
against the mean in per cent, softened by a quarter; all in 64-bit integers. Documents are dealt into groups of bounded
size, each with its own inverted lists. For the term pairs of the queries the lists are intersected beforehand, and
of each intersection the largest joint impact and the highest joint impacts are kept. A query takes its terms
in pairs, heavy first. What the terms still to come can give one document is at most, pair by pair, the largest of
both single maxima and the joint one, which is less than the sum of the single maxima. Once that is below the score
that the last of the best ``top`` has already, documents not met so far cannot enter: from then on only documents that
can still enter are looked up in the lists, and the rest of the lists is skipped. The joint impacts also give a first
score to pass. Ties stay in to the end, so the result is that of scoring every document.

Scale. Documents are read once. A table of ``2 ** MARK_BITS`` bits marks the terms of the queries (its size is fixed;
false marks fall out in a join), so only those terms leave a worker, as arrays of one row per document. Counts of
documents by term are combined sums. Every group of documents meets the whole query set, portion by portion; a task
holds the lists of one group (``GROUP`` entries) and the pairs of one portion (``PORTION`` queries). The best of all
groups are ranked by a window that keeps ``top`` rows per query before it shuffles. Nothing is broadcast by hand.

Cases. Null and empty texts have no terms: such documents count in no statistics and are never returned, such queries
return nothing. Ids are integers; documents with equal or null ids are ranked each on its own, null ids last among equal scores. Queries
equal in id and text are one query. Terms are told apart by 64-bit hashes. Empty tables give an empty one; other
columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.llm import textvec
from gaitframe.session import materialize

MARK_BITS = 22
GROUP = 1 << 20
PORTION = 256


def _terms(marks: np.ndarray | None):
    """Per text: number of its terms, the distinct (marked) ones and how often each occurs."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in textvec.slices(batch.column("text")):
                w = textvec.words(data, at, textvec.NO_TERM)
                h, text = textvec.word_hashes(w), w.text_of_word()
                if marks is not None:
                    hit = np.flatnonzero(marks[textvec.slots(h, MARK_BITS)])
                    h, text = h[hit], text[hit]
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[:len(h)])
                ends = pa.array(np.searchsorted(text[new], np.arange(j - i + 1)).astype(np.int32))
                often = np.diff(np.append(new, len(h))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(ends, pa.array(h[new].view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(often))], ["id", "n", "terms", "often"])

    return over


def _counted(df: DataFrame, doc_id: str, text: str, marks: np.ndarray | None) -> DataFrame:
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_terms(marks), f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<long>, often array<int>")


def _marks(terms: DataFrame) -> np.ndarray:
    """Marks of the hashes in ``term``: at most ``2 ** MARK_BITS / 64`` longs come to the driver, whatever the table."""
    slot = F.call_function("shiftrightunsigned", F.col("term"), F.lit(64 - MARK_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = terms.groupBy(F.shiftright(slot, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).collect()
    words = np.zeros(1 << (MARK_BITS - 6), np.int64)
    words[[r.place for r in rows]] = [r.bits for r in rows]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def weights(postings: DataFrame, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """``term, weight`` of the vocabulary's terms that occur, from one row per document with its ``terms``."""
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.ln((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return df.join(vocabulary, "term").select("term", w.alias("weight")).filter("weight > 0")


class Lists:
    """Inverted lists of one group of documents."""

    def __init__(self, docs: list[pa.RecordBatch]):
        table = pa.Table.from_batches(docs).combine_chunks()
        terms = table.column("terms").combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy())
        term = terms.flatten().to_numpy()
        tf = table.column("often").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = table.column("m").to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(term, kind="stable")
        ids = table.column("id").combine_chunks()
        self.ids, self.null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.term, self.doc = term[order], doc[order]
        self.part = (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))[order]
        self.total = np.zeros(len(sizes), np.int64)
        self.pairs: dict[tuple, tuple[int, int]] = {}

    def of(self, term: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (ascending) and impacts of a term."""
        a, b = np.searchsorted(self.term, term, "left"), np.searchsorted(self.term, term, "right")
        return self.doc[a:b], self.part[a:b] * weight

    def meet(self, one: tuple[int, int], two: tuple[int, int], top: int) -> None:
        """Intersects the lists of a pair and keeps the largest joint impact and the ``top``-th one (0 if there are fewer)."""
        a, b = sorted((self.of(*one), self.of(*two)), key=lambda x: len(x[0]))
        at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
        both = np.flatnonzero(b[0][at] == a[0]) if len(b[0]) else np.zeros(0, np.int64)
        joint = a[1][both] + b[1][at[both]]
        self.pairs[one, two] = (int(joint.max(initial=0)), int(np.partition(joint, -top)[-top]) if len(joint) >= top else 0)

    def best(self, terms: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` best documents and their scores, ``terms`` being (hash, weight) in the order of the pairs."""
        lists = [self.of(*t) for t in terms]
        most = [int(x[1].max(initial=0)) for x in lists]
        bound, need = np.zeros(len(terms) + 1, np.int64), 1
        for i in reversed(range(len(terms))):
            pair = self.pairs.get((terms[i], terms[i + 1])) if i % 2 == 0 and i + 1 < len(terms) else None
            if pair:
                bound[i] = bound[i + 2] + max(pair[0], most[i], most[i + 1])
                need = max(need, pair[1])
            else:
                bound[i] = bound[i + 1] + most[i]
        met, alive, score = [], None, None
        for i, (docs, impacts) in enumerate(lists):
            if alive is None and bound[i] < need:
                alive = np.unique(np.concatenate([np.zeros(0, np.int64), *met]))
                score = self.total[alive]
            if alive is None:
                self.total[docs] += impacts
                met.append(docs)
                reached = self.total[docs]
            else:
                keep = score + bound[i] >= need
                alive, score = alive[keep], score[keep]
                if len(docs) and len(alive):
                    at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                    score = score + np.where(docs[at] == alive, impacts[at], 0)
                reached = score
            if len(reached) >= top:
                need = max(need, int(np.partition(reached, -top)[-top]))
        if alive is None:
            alive = np.unique(np.concatenate([np.zeros(0, np.int64), *met]))
            score = self.total[alive]
        for docs in met:
            self.total[docs] = 0
        alive, score = alive[score >= need], score[score >= need]
        order = np.lexsort((self.ids[alive], self.null[alive], -score))[:top]
        return alive[order], score[order]


def _search(top: int):
    """mapInArrow over rows sorted by group, portion and kind: documents, then of every portion pairs and queries."""

    def answers(lists: Lists, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query, ids, scores = [], [], []
        for key, terms, values in zip(batch.column("query").to_pylist(), batch.column("terms").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            docs, score = lists.best(list(zip(terms, values, strict=True)), top)
            query.append(np.full(len(docs), key, np.int64))
            ids.append(pa.array(lists.ids[docs], mask=lists.null[docs]))
            scores.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.concat_arrays(ids), pa.array(np.concatenate(scores))],
                                         ["query", "doc_id", "score"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, lists, portion = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "portion", "kind")], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(keys) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows, (g, p, kind) = batch.slice(a, b - a), keys[a].tolist()
                if g != group:
                    group, held, lists, portion = g, [], None, None
                if kind == 0:
                    held.append(rows)
                    continue
                if not held and lists is None:
                    continue
                if lists is None:
                    lists, held = Lists(held), []
                if p != portion:
                    lists.pairs.clear()
                    portion = p
                if kind == 1:
                    for terms, values in zip(rows.column("terms").to_pylist(), rows.column("weights").to_pylist(), strict=True):
                        one, two = zip(terms, values, strict=True)
                        lists.meet(one, two, top)
                else:
                    yield from answers(lists, rows)

    return over


def rank_documents(docs: DataFrame, queries: DataFrame, top: int = 20, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
                   query_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: of each query the ``top`` documents with a score above 0 (all, if fewer), equal scores
    by ascending id. Runs jobs (the documents' terms and the queries are written tables)."""
    spark = docs.sparkSession
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(query_text).alias("text")).distinct()
    asked = _counted(asked, "item_id", "text", None).filter("n > 0").withColumnRenamed("id", "item_id")
    asked = materialize(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    vocabulary = materialize(asked.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    counted = _counted(given, "id", "text", _marks(vocabulary)).filter("n > 0")
    postings = materialize(counted.withColumn("key", F.monotonically_increasing_id()), "doc-terms")
    n_docs, n_terms, entries, n_asked = postings.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms").cast("long"))).first() + (asked.count(),)
    if not n_docs or not n_asked:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    weight = materialize(weights(postings, vocabulary, n_docs), "term-weights")
    groups = max(-(-entries // GROUP), min(2 * spark.sparkContext.defaultParallelism, -(-entries // (GROUP // 32))), 1)
    m = 100 - 25 + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    none = F.lit(None).cast("array<long>")
    held = postings.filter("size(terms) > 0").select(
        F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"), F.lit(-1).alias("portion"), F.lit(0).alias("kind"), "id", m.alias("m"), "terms", "often",
        none.alias("weights"), F.lit(None).cast("long").alias("query"))
    # A query's terms, heavy first: neighbours are the pairs.
    weighed = asked.select("query", F.explode(F.arrays_zip("terms", "often")).alias("t")).select("query", F.col("t.terms").alias("term"), F.col("t.often").alias("often"))
    one = F.struct((-F.col("weight") * F.col("often")).alias("w"), "term")
    ordered = weighed.join(weight, "term").groupBy("query").agg(F.array_sort(F.collect_list(one)).alias("t"))
    ordered = materialize(ordered.select("query", F.col("t.term").alias("terms"), F.transform("t.w", lambda w: -w).alias("weights"),
                                         F.pmod(F.xxhash64("query"), F.lit(-(-n_asked // PORTION))).cast("int").alias("portion")), "weighed-queries")
    at = F.sequence(F.lit(0), F.floor(F.size("terms") / 2).cast("int") - 1)
    pairs = ordered.filter("size(terms) > 1").select("portion", F.explode(F.transform(at, lambda i: F.struct(
        F.slice("terms", 2 * i + 1, 2).alias("terms"), F.slice("weights", 2 * i + 1, 2).alias("weights")))).alias("p")).select("portion", "p.*").distinct()

    def everywhere(rows: DataFrame, kind: int, query) -> DataFrame:
        return rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "portion", F.lit(kind).alias("kind"),
                           F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("m"), "terms",
                           F.lit(None).cast("array<int>").alias("often"), "weights", query)

    met = held.union(everywhere(pairs, 1, F.lit(None).cast("long").alias("query"))).union(everywhere(ordered, 2, F.col("query")))
    met = met.repartitionById(groups, "group").sortWithinPartitions("group", "portion", "kind")
    found = met.mapInArrow(_search(top), "query long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
