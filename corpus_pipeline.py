"""A training-corpus pipeline: filter, deduplicate, decontaminate and tokenize ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.llm import bpe, decontaminate, linededup, simhash, toxicity
from gaitframe.session import materialize


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.3 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", folds=4, held_out=2)
    return toxicity.score(docs, model, out="_score").filter("_score < 0.3").drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in an earlier document are deleted; documents of which nothing is left go."""
    out = linededup.drop_repeated_lines(docs, min_words=50, spans="_spans")
    return out.filter((F.size("_spans") == 0) | (F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))).drop("_spans")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id. Documents are linked where their 64-bit
    fingerprints differ by four bits or fewer, and, as these miss most pairs of a similarity of 0.8, also where their five-word
    shingles have one of 0.8 or more (by the whole sets); a group may hold links of both kinds."""
    return simhash.keep_first_linked(docs, [simhash.near_duplicates(docs), simhash.near_duplicates(docs, **simhash.SIMILAR)])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage at an edit similarity of 0.8 or more go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text by the byte-level BPE table, and the text decoded from them."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, ids="ids"), ranks, ids="ids")
    return coded.select("doc_id", "lang", "source", "ids", coded["decoded"].cast("string").alias("decoded"))


STAGES = [("toxicity", toxicity_filter), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("bpe", tokenize)]

#: Fingerprints, winnowing and BPE have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
