"""Labelled documents for the classifiers: held-out folds and bounded training samples."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, at_most: int,
                  text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text, label`` of about ``at_most`` labelled documents outside the held-out fold.

    Labels of one id are combined by their maximum first; ids are then chosen by a hash, so that the choice
    is the same in every run and grows with nothing but the bound. The chosen ids (16 bytes each) are broadcast.
    Null labels and null ids are left out. Runs a count over the labels.
    """
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    share = at_most / max(at_most, known.count())
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")
