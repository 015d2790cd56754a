"""Flight lines, returns and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.ordering import running_sum, with_previous
from pointlake.operators.raster import cells


def overlap(points: DataFrame, step: float) -> DataFrame:
    """col, row, lines (distinct flight lines), and the spread of the lines' lowest and highest heights."""
    by_line = cells(points, step).groupBy("col", "row", "point_source_id").agg(F.min("zi").alias("low"), F.max("zi").alias("high"), F.count(F.lit(1)).alias("n"))
    return by_line.groupBy("col", "row").agg(
        F.count(F.lit(1)).alias("lines"), (F.max("low") - F.min("low")).alias("low_spread"),
        (F.max("high") - F.min("high")).alias("high_spread"), (F.max("n") - F.min("n")).alias("count_spread"),
    )


def overage(points: DataFrame, step: float) -> DataFrame:
    """Adds is_overage: the cell holds a flight line seen at a smaller angle (of equals, with a smaller id)."""
    celled = cells(points, step)
    lines = celled.groupBy("col", "row", "point_source_id").agg(F.min(F.abs("scan_angle_rank")).alias("angle"))
    best = lines.groupBy(F.col("col").alias("__c"), F.col("row").alias("__r")).agg(F.min_by("point_source_id", F.struct("angle", "point_source_id")).alias("__line"))
    joined = celled.join(best, (F.col("col") == F.col("__c")) & (F.col("row") == F.col("__r")))
    return joined.withColumn("is_overage", F.col("point_source_id") != F.col("__line")).select(*points.columns, "is_overage")


def recover_flightlines(points: DataFrame, gap: float) -> DataFrame:
    """Adds line: a new one begins where the time between neighbours of a file is over gap. Points without a time are left out.

    Times of one span of half a gap can't be so far apart, so only the ends of spans are compared: a
    row a span is put in order, not the points, and every point takes the line of its span.
    """
    if gap < 0:
        raise ValueError("a gap is at least 0")
    time = F.col("gps_time")
    span = F.when(F.isnan(time), F.lit(2**63 - 1)).otherwise(F.floor(time / (gap / 2))) if gap else time
    known = points.where("gps_time IS NOT NULL").drop("line").withColumn("__s", span)
    spans = known.groupBy(F.col("source_file").alias("__f"), F.col("__s").alias("__b")).agg(F.min("gps_time").alias("__low"), F.max("gps_time").alias("__high"))
    order = Window.partitionBy("__f").orderBy("__low")
    jump = F.coalesce(F.col("__low") - F.lag("__high").over(order) > gap, F.lit(False)).cast("int")
    lines = spans.withColumn("__j", jump).select("__f", "__b", F.sum("__j").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("line"))
    met = F.col("source_file").eqNullSafe(F.col("__f")) & (F.col("__s") == F.col("__b"))
    return known.join(lines, met).drop("__f", "__b", "__s")


def split_key(column: str, interval: float | None = None) -> Column:
    """What goes to one output: a value, or an interval of values."""
    return F.col(column).cast("long") if interval is None else F.floor(F.col(column) / F.lit(float(interval)))


def split(points: DataFrame, column: str, interval: float | None = None) -> DataFrame:
    """Adds part; write with partitionBy("part")."""
    return points.withColumn("part", split_key(column, interval))


def split_every(points: DataFrame, size: int) -> DataFrame:
    """Adds part: every `size` points of a file."""
    return points.withColumn("part", F.floor(F.col("point_index") / size))


def repair_number_of_returns(points: DataFrame) -> DataFrame:
    """number_of_returns becomes the largest return number of the pulse (file and time); points without a time stay."""
    pulse = Window.partitionBy("source_file", "gps_time")
    timed = points.where("gps_time IS NOT NULL").withColumn("number_of_returns", F.max("return_number").over(pulse))
    return timed.unionByName(points.where("gps_time IS NULL"))  # those aren't one pulse, and don't meet


def check_returns(points: DataFrame) -> DataFrame:
    """Pulses by what is wrong: repeated return numbers, or some that are missing."""
    pulses = points.where("gps_time IS NOT NULL").groupBy("source_file", "gps_time").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("return_number").alias("d"), F.max("number_of_returns").alias("m")
    )
    state = F.when(F.col("d") < F.col("n"), "repeated").when(F.col("d") < F.col("m"), "missing").otherwise("complete")
    return pulses.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("pulses"))


def return_distances(points: DataFrame, step: float) -> DataFrame:
    """Histogram of the height between neighbouring returns of a pulse."""
    pulse = Window.partitionBy("source_file", "gps_time").orderBy("return_number", "point_index")
    fall = (F.lag("zi").over(pulse) - F.col("zi")) * 0.01
    fallen = points.where("gps_time IS NOT NULL").withColumn("fall", fall).where("fall IS NOT NULL")
    return fallen.groupBy(F.floor(F.col("fall") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scan_lines(points: DataFrame) -> DataFrame:
    """Adds scan_line: counts changes of direction within a file."""
    change = F.coalesce(F.col("__d") != F.col("scan_direction_flag"), F.lit(False)).cast("int")
    return running_sum(with_previous(points, "scan_direction_flag", "__d"), change, "scan_line").drop("__d")
