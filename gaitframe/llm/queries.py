"""Registered queries of the numbered operators, each over its whole table with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm import (
    bpe, decontaminate, embeddings, hmm, licenses, linededup, negatives, quality, ranked, sharding, simhash, toxicity, warc)
from gaitframe.llm.labels import fold
from gaitframe.session import scratch_path

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classified(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    docs = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return docs.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")[0]))


@query("op2_embeddings", """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
usable AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
             AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN parts ON a = vec_id
""")
def op2_embeddings(spark, sf_dir):
    return embeddings.similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op3_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN g ON p.h = g.h
""")
def op3_warc(spark, sf_dir):
    """Archives of all pages, read back: sizes and digests are those of the payloads read, for revisits those of their headers."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.col("page_id").alias("revisit_order"),
                                                 F.concat(F.lit("urn:page:"), F.col("page_id")).alias("record_id"))
    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path, "record_id", "url", "html", revisit_bytes=1000)
    back = warc.read_archive(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "payload_length", "payload"])

    def page(c):
        return F.substring_index(c, ":", -1).cast("long")

    return back.select(page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
                       F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)


@query("op4_quality")
def op4_quality(spark, sf_dir):
    """Conditional random field fitted outside the fold crc32 mod 5 = 0."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return classified(quality.score(docs.select("doc_id", "text"), model), folds=5, held_out=0)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    """FTRL logistic regression fitted outside the fold crc32 mod 4 = 2."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", folds=4, held_out=2)
    return classified(toxicity.score(docs.select("doc_id", "text"), model), folds=4, held_out=2)


@query("op6_decontaminate")
def op6_decontaminate(spark, sf_dir):
    """A row per document and benchmark item with a passage within the edit bound."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8, recall=0.98)


@query("op9_line_dedup")
def op9_line_dedup(spark, sf_dir):
    """A row per document: the text without repeated passages and the deleted runs of lines."""
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50, spans="removed")
    return out.select("doc_id", F.size("removed").alias("n_runs"),
                      F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["n_words"]).alias("removed_words"), "removed", "text")


@query("op8_hmm_lm")
def op8_hmm_lm(spark, sf_dir):
    """Hidden Markov model fitted outside the fold crc32 mod 7 = 2."""
    return hmm.score_documents(table(spark, sf_dir, "documents"), folds=7, held_out=2)


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(coded.drop("text"), ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10
""")
def op11_hard_negatives(spark, sf_dir):
    """Negatives of every hundredth vector; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term),
i AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
m AS (SELECT k, doc_id, 100 - 25 + (25 * len(terms) * big_n) // big_l AS m FROM d, c),
s AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
""")
def op12_ranked_search(spark, sf_dir):
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def _license_sql(gram: int = 3, similarity: float = 0.8) -> str:
    """The same scan in SQL, from the list of the templates' runs."""
    runs = licenses.template_grams(licenses.NOTICES, licenses.PHRASES, gram)
    values = ", ".join(f"({t}, '{label}', {phrase}, {n}, {size}, {j}, '{run}')" for t, label, phrase, n, size, j, _, run in runs)
    covered = "len(list_distinct(flatten(list_transform({0}, lambda p: range(p, p + size)))))"
    return f"""
WITH t(template, label, phrase, n, size, j, run) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT k, size, i, array_to_string(w[i + 1:i + size], ' ') AS run
      FROM (SELECT k, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM t))),
diag AS (SELECT k, template, label, phrase, n, size, i - j AS diagonal, list(i) AS i, list(j) AS j FROM g JOIN t USING (size, run) GROUP BY ALL),
based AS (SELECT *, phrase AND len(i) = n - size + 1 AS base, floor(diagonal / greatest(2, n // 5))::INT AS win FROM diag),
near AS (SELECT k, label, n, size, false AS base, flatten(list(i)) AS i, flatten(list(j)) AS j
         FROM (SELECT *, unnest([win - 1, win]) AS side FROM based) GROUP BY k, template, label, n, size, side),
spans AS (SELECT k, label, base, list_min(i) AS first,
                 least({covered.format('i')}, {covered.format('j')}) / greatest(n, list_max(i) - list_min(i) + size) AS similarity
          FROM (SELECT k, label, n, size, base, i, j FROM based UNION ALL SELECT * FROM near)),
known AS (SELECT k, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR similarity >= {similarity}) AS labels, max(similarity) AS score
          FROM spans GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN known USING (k)
"""


@query("op13_license_scan", _license_sql())
def op13_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), gram=3, similarity=0.8).drop("spans")
