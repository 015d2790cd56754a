"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import materialise


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """From edges (u, v): (node, component), component being the smallest node reachable.

    In a large star every node sends its larger neighbours to its smallest one; in a small star
    every node sends the rest of its smaller ones there. Both keep components as they are, and
    alternating them ends in stars after a number of rounds that grows with the logarithm of
    their size. Neighbours are only ever joined to one minimum each, never collected, and every
    round is a written table. Loops are dropped; nodes without an edge aren't returned.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        joined = both.join(least, F.col("u") == F.col("c"))
        if large:
            return tidy(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        return tidy(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialise(tidy(edges), "components")
    seen = mark(now)
    for _ in range(rounds):
        now = materialise(star(star(now, True), False), "components")
        fresh = mark(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
