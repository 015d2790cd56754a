"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of doc_id written as text, modulo folds; a null doc_id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(labels: DataFrame, label: str, keep: Column, limit: int, seed: int = 7) -> DataFrame:
    """At most `limit` rows (doc_id, y) of the labels for which keep holds, by a hash of doc_id.

    Repeated doc_ids count once, with the largest label. The order of the hash is the same
    in every run, so that reruns draw the same rows.
    """
    one = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


def one_text_each(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the sample's doc_ids, one row each: of a repeated doc_id the text of the least hash."""
    met = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # a sample has 12 bytes a row
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
