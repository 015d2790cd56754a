"""Whole workflows over flight lines and very large clouds: every step is an operator, and Spark plans them as one job.

Cutting into tiles and merging the results again, which a folder of files needs, is what the
tiles of `triangulation` do inside a job; there are no files in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.operators import aggregates, cleaning, flightlines, spatial, surface
from pointlake.operators.filters import xyz
from pointlake.schema import DEFAULT_SCALE, ScaleOffset
from pointlake.sources import las

KEY = ["source_file", "point_index"]


def with_ground(points: DataFrame, step: float, offset: float) -> DataFrame:
    """Points with ground found and written as class 2; what was class 2 and isn't ground becomes 1."""
    ground = surface.classify_ground(points, step, offset)
    was = F.when(F.col("classification") == 2, 1).otherwise(F.col("classification"))
    return points.join(ground, KEY).withColumn("classification", F.when(F.col("is_ground"), 2).otherwise(was)).drop("is_ground")


def normalize(points: DataFrame) -> DataFrame:
    """Points with heights above the class 2 surface in place of z; points outside of it go."""
    heights = surface.height_above_ground(points).where("height IS NOT NULL")
    return points.join(heights, KEY).withColumn("zi", F.round(F.col("height") * 100).cast("int")).drop("height")


def terrain_model(points: DataFrame, step: float, kill: float = 100.0) -> DataFrame:
    """col, row, value: the ground's surface."""
    return surface.dem(surface.tin(points.where("classification = 2")), step, kill)


def surface_model(points: DataFrame, step: float, kill: float = 100.0) -> DataFrame:
    """col, row, value: the surface of first returns."""
    return surface.dem(surface.tin(points.where("return_number <= 1")), step, kill)


def canopy_model(normalized: DataFrame, step: float, thin: float, kill: float = 100.0) -> DataFrame:
    """col, row, value: the surface of the highest point of each cell of `thin`."""
    highest = cleaning.thin_by_cell(normalized.where("return_number <= 1"), thin, "highest").drop("cx", "cy")
    return surface.dem(surface.tin(highest), step, kill)


def pit_free_canopy_model(
    normalized: DataFrame, step: float, thin: float, levels: tuple[float, ...] = (0.0, 2.0, 5.0, 10.0, 15.0, 20.0), kill: float = 10.0, first_kill: float = 100.0
) -> DataFrame:
    """col, row, value: of surfaces over the points from each level up, without edges over `kill` above the lowest level, the highest."""
    highest = cleaning.thin_by_cell(normalized.where("return_number <= 1"), thin, "highest").drop("cx", "cy")
    layers = [surface.dem(surface.tin(highest.where(xyz("z") >= level)), step, first_kill if k == 0 else kill) for k, level in enumerate(levels)]
    merged = layers[0]
    for layer in layers[1:]:
        merged = merged.union(layer)
    return merged.groupBy("col", "row").agg(F.max("value").alias("value"))


def quality_report(points: DataFrame, step: float) -> DataFrame:
    """item, value: rules that failed, points, cells, density, and how many flight lines the cells hold."""
    rules = aggregates.validate(points).select(F.concat(F.lit("failed: "), "rule").alias("item"), F.col("failed").cast("double").alias("value"))
    lines = flightlines.overlap(points, step)
    covered = aggregates.occupancy(points, step)
    items = lambda df, of: df.select(F.explode(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("double"))])).alias("item", "value"))
    cover = items(covered, {"points": F.col("points"), "cells": F.col("cells"), "density": F.col("density")})
    lap = items(lines.agg(F.max("lines").alias("m"), F.count_if(F.col("lines") > 1).alias("n")), {"most lines in a cell": F.col("m"), "cells with several lines": F.col("n")})
    return rules.union(cover).union(lap)


def fitting_scaling(points: DataFrame, without_fluff: bool = False, scaling: ScaleOffset = DEFAULT_SCALE) -> ScaleOffset:
    """A scaling for files of these points: offsets are the box's middle in whole ten millions of steps, so that raw values stay small.

    without_fluff: an axis on which all raw values end in the same zeros (up to three) has steps that are so many times longer.
    One aggregate of a row; no points leave everything as it is.
    """
    out = []
    for a in "xyz":
        out += [F.min(f"{a}i"), F.max(f"{a}i"), *[F.max(F.when(F.col(f"{a}i") % 10**k != 0, 1)).isNull() for k in (1, 2, 3)]]
    row = points.agg(*[v.alias(f"c{i}") for i, v in enumerate(out)]).first()
    scale, offset = [], []
    for k in range(3):
        low, high, *zeros = row[5 * k : 5 * k + 5]
        if low is None:
            return scaling
        step = round(scaling.scale[k] * 10 ** (sum(zeros) if without_fluff else 0), 12)
        low, high = (v * scaling.scale[k] + scaling.offset[k] for v in (low, high))
        scale.append(step)
        offset.append(int((low + high) / step / 20_000_000) * 10_000_000 * step)
    return ScaleOffset(tuple(scale), tuple(offset))


def write_optimized(points: DataFrame, path: str, cell: float, mode: str = "overwrite") -> ScaleOffset:
    """Points as LAS files that are easy to pack and to search: in the order of a space-filling curve, user data zero, without fluff, with rounded offsets."""
    las.register(points.sparkSession)
    fit = fitting_scaling(points, True)
    sorted_ = spatial.sort_spatially(points, cell).withColumn("user_data", F.lit(0))
    text = lambda v: ",".join(map(repr, v))
    sorted_.write.format("las").options(scale=text(fit.scale), offset=text(fit.offset)).mode(mode).save(path)
    return fit


def remove_duplicates(points: DataFrame) -> DataFrame:
    """One point of each place: equal places meet by their coordinates, so no tiles are needed."""
    return cleaning.drop_duplicates(points, ("xi", "yi", "zi"))


def sort_in_time(points: DataFrame) -> DataFrame:
    """By time; points without one come last."""
    return spatial.sort_by(points, F.col("gps_time").asc_nulls_last())


def raster_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """col, row, value: left less right where both have a cell."""
    return left.join(right.withColumnRenamed("value", "__v"), ["col", "row"]).select("col", "row", (F.col("value") - F.col("__v")).alias("value"))


def point_view(points: DataFrame, name: str = "points") -> None:
    """Makes points, with x, y and z, a view for spark.sql."""
    points.withColumns({a: xyz(a) for a in "xyz"}).createOrReplaceTempView(name)


