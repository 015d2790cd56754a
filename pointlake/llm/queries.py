"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.audit import AUDIT_SQL, audit_filters
from pointlake.llm.blocks import usable
from pointlake.llm.hashing_index import hamming_top_k
from pointlake.llm.language import fit_language, predict_language
from pointlake.llm.licenses import scan_licenses, scan_sql
from pointlake.llm.mixing import mix
from pointlake.llm.mtree import exact_top_k
from pointlake.llm.pieces import PieceModel, encode_texts
from pointlake.llm.quality import ACCEPT_FROM, fit_quality, score_quality
from pointlake.llm.sampling import fold
from pointlake.llm.sharding import shard_documents
from pointlake.llm.simhash import near_duplicates
from pointlake.llm.spelling import spelling_variants
from pointlake.llm.suffixes import remove_repeats
from pointlake.llm.toxicity import fit_toxicity, score_toxicity


#: A public vocabulary; the queries take another path as an argument.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    rows = _read(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", whole.alias("vector"))
    return exact_top_k(rows, F.col("vec_id") % 100 == 0, 10)


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return hamming_top_k(rows, F.col("vec_id") % 20 == 0, 20)


def op7_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, PieceModel.load(model_path), check=True).withColumn("n_ids", F.size("ids"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, fold("doc_id", 4) != 2)
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return score_quality(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT_FROM).cast("int").alias("predicted")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), _read(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_shard_documents": op5_shard_documents,
    "op6_nearest": op6_nearest,
    "op7_pieces": op7_pieces,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {"op11_filter_audit": AUDIT_SQL, "op13_license_scan": scan_sql()}
