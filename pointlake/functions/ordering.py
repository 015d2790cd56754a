"""What depends on the points before in a file, without a file's points in one task.

Points of a file are dealt to blocks of their numbers (point_index). A block is put in order by
one task; what comes from the blocks before is one row a block, and those rows are put in order
for each file. Points without a number come first, in one block of their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _in_block() -> WindowSpec:
    return Window.partitionBy("source_file", "__block").orderBy("point_index")


def _with_block(points: DataFrame) -> DataFrame:
    return points.withColumn("__block", F.floor(F.col("point_index") / BLOCK))


def _of_block(dealt: DataFrame, whole: Column, before: Column) -> DataFrame:
    """dealt with __before: `before` over the rows a block (source_file, __block, __whole), in the blocks' order."""
    blocks = dealt.groupBy("source_file", "__block").agg(whole.alias("__whole")).withColumn("__before", before)
    blocks = blocks.select(F.col("source_file").alias("__f"), F.col("__block").alias("__b"), "__before")
    met = F.col("source_file").eqNullSafe(F.col("__f")) & F.col("__block").eqNullSafe(F.col("__b"))
    return dealt.join(blocks, met, "left").drop("__f", "__b")


def running_sum(points: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over the file's points up to this one."""
    earlier = Window.partitionBy("source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = _of_block(_with_block(points).withColumn("__value", value), F.sum("__value"), F.sum("__whole").over(earlier))
    inside = F.sum("__value").over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside + F.coalesce("__before", F.lit(0))).drop("__block", "__value", "__before")


def with_previous(points: DataFrame, column: str, name: str) -> DataFrame:
    """Adds name: the column's value at the file's point before, null at the first."""
    last = F.lag("__whole").over(Window.partitionBy("source_file").orderBy("__block"))
    dealt = _of_block(_with_block(points), F.max_by(column, F.struct("point_index")), last)
    first = F.row_number().over(_in_block()) == 1
    return dealt.withColumn(name, F.when(first, F.col("__before")).otherwise(F.lag(column).over(_in_block()))).drop("__block", "__before")
