"""Connected components of graphs of any size, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.tables import written


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node and component, the smallest node that can be reached, from edges (u, v). Loops are dropped; nodes without an edge aren't returned.

    In each round every node joins that of its neighbours and itself which a hash puts first, and
    the graph is contracted to the nodes that were joined. The hash is another one in each round,
    so about a third of the nodes are left after one, whatever the shape of the graph: chains as well as stars.
    """
    now = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    home = written(now.select(F.col("u").alias("node")).union(now.select("v")).distinct().withColumn("at", F.col("node")), "nodes")
    for k in range(most_rounds):
        if now.isEmpty():
            break
        both = now.union(now.select("v", "u"))
        order = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("hash"), F.col(c).alias("node"))
        near = both.groupBy("u").agg(F.min(order("v")).alias("best"))
        step = written(near.select(F.col("u").alias("old"), F.least(F.col("best"), order("u"))["node"].alias("new")), "joins")
        now = now.join(step, F.col("u") == F.col("old")).select(F.col("new").alias("u"), "v")
        now = now.join(step, F.col("v") == F.col("old")).select("u", F.col("new").alias("v"))
        now = written(now.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        home = written(home.join(step, F.col("at") == F.col("old"), "left").select("node", F.coalesce("new", "at").alias("at")), "nodes")
    else:
        raise RuntimeError("the components did not settle")
    least = home.groupBy("at").agg(F.min("node").alias("component"))
    return home.join(least, "at").select("node", "component")
