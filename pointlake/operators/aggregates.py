"""Inventories, summaries and histograms: partial sums on every task, small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.operators.filters import xyz
from pointlake.operators.transforms import ADJUSTED_WEEK, WEEK_SECONDS

SUMMARY_FIELDS = (
    "xi", "yi", "zi", "intensity", "return_number", "number_of_returns", "classification", "scan_angle_rank", "user_data",
    "point_source_id", "gps_time", "red", "green", "blue", "nir", "ext_classification", "scanner_channel",
)


def inventory(points: DataFrame) -> DataFrame:
    """Per file: points, points by return 1 to 5, and the raw bounding box."""
    by_return = [F.count_if(F.col("return_number") == r).alias(f"return_{r}") for r in range(1, 6)]
    box = [f(c).alias(f"{n}_{c}") for c in ("xi", "yi", "zi") for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), *by_return, *box)


def summary(points: DataFrame) -> DataFrame:
    """field, low, high, filled: least and largest value of every field, in one pass."""
    wide = points.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in SUMMARY_FIELDS for n, f in (("low", F.min), ("high", F.max))],
        *[F.count(c).alias(f"filled_{c}") for c in SUMMARY_FIELDS],
    )
    rows = [F.struct(F.lit(c).alias("field"), *[F.col(f"{n}_{c}").alias(n) for n in ("low", "high", "filled")]) for c in SUMMARY_FIELDS]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def counts_by(points: DataFrame, column: str) -> DataFrame:
    return points.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def flag_counts(points: DataFrame) -> DataFrame:
    flags = ("synthetic_flag", "keypoint_flag", "withheld_flag", "overlap_flag", "edge_of_flight_line")
    return points.agg(*[F.sum(f).alias(f) for f in flags])


def histogram(points: DataFrame, value: Column, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, n and the mean value of each bin; with low and high, values are clamped first."""
    value = value.cast("double")
    if low is not None and high is not None:
        value = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    binned = points.select(F.floor(value * F.lit(1.0 / step)).alias("bin"), value.alias("v")).where("v IS NOT NULL")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def histogram_of_mean(points: DataFrame, value: Column, step: float, other: Column) -> DataFrame:
    """bin, n and the mean of another value in each bin."""
    binned = points.select(F.floor(value.cast("double") * F.lit(1.0 / step)).alias("bin"), other.cast("double").alias("v"))
    return binned.where("bin IS NOT NULL").groupBy("bin").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def fluff(points: DataFrame) -> DataFrame:
    """Per axis whether all raw values end on the same 1 to 4 digits: coordinates finer than measured."""
    axes = []
    for axis in ("xi", "yi", "zi"):
        digits = {k: F.min(F.pmod(F.col(axis), F.lit(10**k))) == F.max(F.pmod(F.col(axis), F.lit(10**k))) for k in range(1, 5)}
        axes.append(F.struct(F.lit(axis).alias("axis"), *[v.alias(f"fluff_{10**k}") for k, v in digits.items()]))
    return points.agg(F.array(*axes).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def occupancy(points: DataFrame, step: float) -> DataFrame:
    """Number of occupied cells, their bounding box, area and the density of points in it."""
    cells = points.groupBy(F.floor(xyz("x") / step).alias("cx"), F.floor(xyz("y") / step).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    box = [f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("min", F.min), ("max", F.max))]
    counted = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points"), *box)
    return counted.withColumns({"area": F.col("cells") * float(step * step), "density": F.try_divide(F.col("points").cast("double"), F.col("cells") * float(step * step))})


def gps_weeks(points: DataFrame) -> DataFrame:
    """Points of each GPS week of adjusted standard time."""
    week = F.floor(F.col("gps_time") / WEEK_SECONDS + ADJUSTED_WEEK).alias("week")
    return points.where("gps_time IS NOT NULL").groupBy(week).agg(F.count(F.lit(1)).alias("n"))


def precision(points: DataFrame, axis: str = "xi") -> DataFrame:
    """How often each difference of neighbours occurs among the sorted raw values.

    Equal values make differences of zero and are counted first, so only distinct values are
    sorted. They are compared within ranges of 4,096, then the ends of neighbouring ranges within
    ranges of 1,024 of them, and so once more: raw values have 32 bits, so no task sorts more than
    4,096 values of a range, whatever the cloud. A difference over 31 bits is null; nulls take no part.
    """
    from pyspark.sql import Window

    counts = points.groupBy(F.col(axis).alias("v")).agg(F.count(F.lit(1)).alias("c")).where("v IS NOT NULL")
    level, found = counts.select(F.col("v").alias("a"), F.col("v").alias("b")), None
    for span in (1 << 12, 1 << 22, 1 << 32):
        level = level.withColumn("r", F.floor((F.col("a").cast("long") + F.lit(1 << 31)) / span))
        gaps = level.withColumn("p", F.lag("b").over(Window.partitionBy("r").orderBy("a"))).where("p IS NOT NULL").groupBy(F.try_subtract("a", "p").alias("diff")).agg(F.count(F.lit(1)).alias("n"))
        found = gaps if found is None else found.union(gaps)
        level = level.groupBy("r").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    zeros = counts.agg(F.sum(F.col("c") - 1).alias("n")).select(F.lit(0).cast("int").alias("diff"), "n").where("n > 0")
    return found.union(zeros).groupBy("diff").agg(F.sum("n").alias("n"))


def validate(points: DataFrame) -> DataFrame:
    """rule, failed: how many points break each rule of the format."""
    rules = {
        "return number is zero": F.col("return_number") < 1,
        "number of returns is zero": F.col("number_of_returns") < 1,
        "return number over number of returns": F.col("return_number") > F.col("number_of_returns"),
        "class over 31 in the legacy field": F.col("classification") > 31,
        "scan angle beyond 90 degrees": F.abs("scan_angle_rank") > 90,
        "no gps time": F.col("gps_time").isNull(),
    }
    wide = points.agg(*[F.count_if(v).alias(f"r{i}") for i, v in enumerate(rules.values())])
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failed")) for i, name in enumerate(rules)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("verdict", F.when(F.col("failed") == 0, "pass").otherwise("fail"))
