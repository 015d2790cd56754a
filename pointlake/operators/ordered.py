"""Order-aware filters: what is kept depends on the points of the file that came before.

Each sees only the points that earlier filters left, so they are applied in turn. State starts
anew in each source_file, and so windows are partitioned by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.columns import cell
from pointlake.functions.ordering import running_sum, with_previous
from pointlake.operators.filters import xyz


def _number(points: DataFrame) -> DataFrame:
    return running_sum(points, F.lit(1), "__k")


def keep_every_nth(points: DataFrame, n: int) -> DataFrame:
    return _number(points).where(F.col("__k") % n == 0).drop("__k")


def drop_every_nth(points: DataFrame, n: int) -> DataFrame:
    return _number(points).where(F.col("__k") % n != 0).drop("__k")


def keep_random_fraction(points: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A point stays by a hash of its file and number: the same points in every run, without a shuffle."""
    draw = F.pmod(F.xxhash64("source_file", "point_index", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return points.where(draw < fraction)


def keep_scan_direction_change(points: DataFrame) -> DataFrame:
    """Points whose direction differs from that of the point before; a file's first point goes."""
    return with_previous(points, "scan_direction_flag", "__d").where(F.col("__d") != F.col("scan_direction_flag")).drop("__d")


def _first_of(points: DataFrame, *cells: Column) -> DataFrame:
    names = [f"__c{i}" for i in range(len(cells))]
    window = Window.partitionBy("source_file", *names).orderBy("point_index")
    numbered = points.withColumns(dict(zip(names, cells, strict=True))).withColumn("__k", F.row_number().over(window))
    return numbered.where("__k = 1").drop("__k", *names)


def thin_with_grid(points: DataFrame, step: float) -> DataFrame:
    """The first point of each square cell."""
    return _first_of(points, cell(xyz("x"), step), cell(xyz("y"), step))


def thin_points_with_time(points: DataFrame, step: float) -> DataFrame:
    """The first point of each span of time; points without a time share one span."""
    return _first_of(points, cell(F.coalesce("gps_time", F.lit(0.0)), step))


def thin_pulses_with_time(points: DataFrame, step: float) -> DataFrame:
    """Of each span of time all points with the time of its first point."""
    time = F.coalesce("gps_time", F.lit(0.0))
    window = Window.partitionBy("source_file", "__c").orderBy("point_index").rowsBetween(Window.unboundedPreceding, 0)
    first = points.withColumn("__c", cell(time, step)).withColumn("__t", F.first(time).over(window))
    return first.where(F.col("__t") == time).drop("__c", "__t")


ORDERED: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        keep_every_nth, drop_every_nth, keep_random_fraction, keep_scan_direction_change, thin_with_grid,
        thin_points_with_time, thin_pulses_with_time,
    )
}
ORDERED["thin_with_time"] = thin_pulses_with_time
