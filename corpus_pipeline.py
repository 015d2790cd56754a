"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import drop_path, pack_rest, scratch, shared_path, unpack_rest
from pointlake.llm.mixing import mixed_documents
from pointlake.llm.pieces import PieceModel, encode_texts
from pointlake.llm.quality import ACCEPT_FROM, fit_quality, score_quality
from pointlake.llm.queries import PIECE_MODEL
from pointlake.llm.simhash import keep_one_of_each
from pointlake.llm.suffixes import remove_repeats

REJECT_BELOW = ACCEPT_FROM  # operator 10's own decision


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels, gives REJECT_BELOW or more."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, "__score").where(F.col("__score") >= REJECT_BELOW).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), by operator 3's search first."""
    return keep_one_of_each(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a smaller doc_id has as well.

    A document keeps its row even if nothing is left of its text. n_chars is counted anew.
    """
    cut = remove_repeats(pack_rest(docs, "doc_id", "text"), 50).select("doc_id", "text", "__rest")
    whole = unpack_rest(cut, docs.columns, "doc_id", "text")
    return whole.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else whole


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; documents of large targets come up to three times."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of the text."""
    return encode_texts(docs.select("doc_id", "source", "text"), PieceModel.load(PIECE_MODEL), check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: SQL can't express the stages; tests compare each with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. In the shared folder only the last stage's input stays: the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):  # what the stage wrote besides goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
