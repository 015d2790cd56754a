"""Rasters as (col, row, value) rows: one aggregation by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.operators.filters import xyz

#: value of a cell from the column given
STATISTICS = {
    "highest": F.max, "lowest": F.min, "average": F.avg, "stddev": F.stddev_pop,
    "range": lambda v: F.max(v) - F.min(v), "counter": lambda v: F.count(v).cast("double"),
}


def cells(points: DataFrame, step: float) -> DataFrame:
    return points.withColumns({"col": F.floor(xyz("x") / step), "row": F.floor(xyz("y") / step)})


def grid(points: DataFrame, step: float, statistic: str, value: Column | None = None) -> DataFrame:
    """col, row and value of each occupied cell."""
    value = xyz("z") if value is None else value.cast("double")
    return cells(points.withColumn("__v", value), step).groupBy("col", "row").agg(STATISTICS[statistic]("__v").alias("value"))


def grid_density(points: DataFrame, step: float) -> DataFrame:
    return grid(points, step, "counter").withColumn("value", F.col("value") / float(step * step))


def grid_pulse_density(points: DataFrame, step: float) -> DataFrame:
    """Last returns for each square unit."""
    return grid_density(points.where("return_number >= number_of_returns"), step)


def grid_majority(points: DataFrame, step: float, column: str = "classification") -> DataFrame:
    """The most frequent value of each cell, the smaller of equally frequent ones."""
    counted = cells(points, step).groupBy("col", "row", F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("col", "row").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("value"))


def grid_scan_angle_lowest(points: DataFrame, step: float) -> DataFrame:
    return grid(points, step, "lowest", F.abs("scan_angle_rank"))


def fill(raster: DataFrame, reach: int = 1) -> DataFrame:
    """Empty cells within `reach` of filled ones get the mean of those; a filled cell offers itself to its neighbours."""
    side = F.sequence(F.lit(-reach), F.lit(reach))
    offered = raster.select(F.explode(side).alias("dc"), "col", "row", "value").select(F.explode(side).alias("dr"), "dc", "col", "row", "value")
    near = offered.select((F.col("col") + F.col("dc")).alias("col"), (F.col("row") + F.col("dr")).alias("row"), "value", ((F.col("dc") == 0) & (F.col("dr") == 0)).alias("own"))
    own = F.max(F.when(F.col("own"), F.col("value")))
    return near.groupBy("col", "row").agg(F.coalesce(own, F.avg("value")).alias("value"))


def subcircle(points: DataFrame, radius: float) -> DataFrame:
    """Each point and eight more on a circle around it; x and y are real numbers."""
    import math

    ring = [(0.0, 0.0), *((radius * math.cos(k * math.pi / 4), radius * math.sin(k * math.pi / 4)) for k in range(8))]
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ring]))
    return points.withColumn("__s", shifts).withColumns({"x": xyz("x") + F.col("__s.dx"), "y": xyz("y") + F.col("__s.dy")}).drop("__s")


def grid_subcircle_highest(points: DataFrame, step: float, radius: float) -> DataFrame:
    spread = subcircle(points, radius).select(F.floor(F.col("x") / step).alias("col"), F.floor(F.col("y") / step).alias("row"), xyz("z").alias("z"))
    return spread.groupBy("col", "row").agg(F.max("z").alias("value"))


def canopy(
    points: DataFrame, step: float, cutoff: float = 1.37, percentiles: tuple[int, ...] = (25, 50, 95), bincentiles: tuple[int, ...] = (50,),
    counts: tuple[float, ...] = (), height: Column | None = None,
) -> DataFrame:
    """Height metrics of each cell: points above the cutoff for heights, first returns for cover.

    cov: first returns above the cutoff among first returns, in percent; dns: the same of all
    returns; gap: 100 - cov; bNN: share of points below NN percent of the cell's highest;
    cI: points between neighbouring counts, dI: the same in percent of all points.
    """
    h = xyz("z") if height is None else height
    rows = cells(points.withColumn("h", h), step)
    high, first = F.col("h") > cutoff, F.col("return_number") <= 1
    up = F.when(high, F.col("h"))
    n, m = F.count(F.lit(1)), F.avg(up)
    out = {
        "n": n, "min": F.min(up), "max": F.max(up), "avg": m, "std": F.stddev_pop(up), "ske": F.skewness(up), "kur": F.kurtosis(up) + 3,
        "qav": F.sqrt(F.avg(up * up)), "cov": F.try_divide(100.0 * F.count_if(high & first), F.count_if(first)),
        "dns": 100.0 * F.count_if(high) / n,
    }
    out |= {f"p{p:02d}": F.percentile(up, F.lit(p / 100)) for p in percentiles}
    grouped = rows.groupBy("col", "row")
    for i, (a, b) in enumerate(zip(counts, counts[1:], strict=False)):
        inside = F.count_if((F.col("h") >= a) & (F.col("h") < b))
        out |= {f"c{i:02d}": inside, f"d{i:02d}": 100.0 * inside / n}
    made = grouped.agg(*[v.alias(k) for k, v in out.items()]).withColumn("gap", 100.0 - F.col("cov"))
    if bincentiles:
        tops = made.select(F.col("col").alias("__c"), F.col("row").alias("__r"), F.col("max").alias("__top"))
        low = rows.join(tops, (F.col("col") == F.col("__c")) & (F.col("row") == F.col("__r"))).where("h > " + str(cutoff))
        share = {f"b{b:02d}": 100.0 * F.count_if(F.col("h") < F.col("__top") * (b / 100)) / F.count(F.lit(1)) for b in bincentiles}
        made = made.join(low.groupBy("col", "row").agg(*[v.alias(k) for k, v in share.items()]), ["col", "row"], "left")
    return made


def plots(points: DataFrame, circles: DataFrame, cutoff: float = 1.37) -> DataFrame:
    """Metrics of circular plots (name, cx, cy, radius): plots meet points through square cells as wide as the largest plot."""
    widest = circles.agg(F.max("radius")).first()[0]
    if widest is None:
        widest = 1.0
    step = max(2.0 * widest, 1e-9)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    p = circles.withColumn("dc", near).withColumn("dr", near)
    p = p.select("name", "cx", "cy", "radius", (F.floor(F.col("cx") / step) + F.col("dc")).alias("pc"), (F.floor(F.col("cy") / step) + F.col("dr")).alias("pr"))
    met = cells(points, step).join(p, (F.col("col") == F.col("pc")) & (F.col("row") == F.col("pr")))
    inside = (xyz("x") - F.col("cx")) ** 2 + (xyz("y") - F.col("cy")) ** 2 < F.col("radius") ** 2
    up = F.when(xyz("z") > cutoff, xyz("z"))
    return met.where(inside).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(up).alias("max"), F.avg(up).alias("avg"))
