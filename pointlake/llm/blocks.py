"""A stated set of queries against all rows, in blocks: cells of rows meet chunks of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm.common import materialise


def usable(vector: Column, kind: str = "double") -> Column:
    """Not null, and no component null, NaN or infinite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast(kind)) & (F.abs(x.cast(kind)) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, ok), F.lit(False))


def stack(vectors: pd.Series, width: int, kind: type) -> np.ndarray:
    """Vectors as rows; what is missing at the end of a shorter one counts as zero."""
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_join(
    cells: DataFrame, queries: DataFrame, chunks: int, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """search(rows of a cell, queries of a chunk that visit the cell) for every such pair that has queries.

    cells has `cell`; queries has `q`, a number of its own for each query, and `visits` (array of cells). A cell goes once to each
    chunk that asks for it, so that a task holds one cell and one chunk, both of bounded size.
    """
    asked = materialise(queries.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")), "asked")
    asked = asked.withColumn("cell", F.explode("visits")).drop("visits")
    pairs = asked.select(F.col("cell").alias("__cell"), F.col("chunk").alias("__chunk")).distinct()
    spread = cells.join(pairs, F.col("cell") == F.col("__cell")).select(*cells.columns, F.col("__chunk").alias("chunk"))

    def both(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return search(rows, wanted)

    return spread.groupBy("cell", "chunk").cogroup(asked.groupBy("cell", "chunk")).applyInPandas(both, schema)


def numbered_queries(rows: DataFrame, *more: str) -> DataFrame:
    """q, query_id, vector (and more columns, given by those two) of rows with vec_id and vector: each distinct pair once, however often it comes."""
    each = rows.groupBy(F.col("vec_id").alias("query_id"), "vector").agg(*[F.min(c).alias(c) for c in more], F.count(F.lit(1)).alias("__n")).drop("__n")
    return materialise(each.select(F.monotonically_increasing_id().alias("q"), "query_id", "vector", *more), "queries")


def best(found: DataFrame, k: int) -> DataFrame:
    """q, query_id, rank (from 1), vec_id and score of each query's k best; ties to the smaller vec_id."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("q", "query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
