"""Operators over two inputs: merge, compare, copy attributes, control points, trajectories, colours, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.operators.filters import xyz
from pointlake.operators.surface import heights_at, tin
from pointlake.schema import DEFAULT_SCALE, ScaleOffset


def merge(*parts: tuple[DataFrame, ScaleOffset], to: ScaleOffset = DEFAULT_SCALE) -> DataFrame:
    """Union of inputs with their own scaling, requantised to one. Columns that an input lacks are null."""
    out: DataFrame | None = None
    for points, scaling in parts:
        same = points.withColumns({f"{a}i": to.raw(a, scaling.real(a)) for a in "xyz"}) if scaling != to else points
        out = same if out is None else out.unionByName(same, allowMissingColumns=True)
    return out


def diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """source_file, point_index and `changed`: the names of the columns that differ, or which side lacks the point."""
    key = ["source_file", "point_index"]
    a = left.select(*key, F.struct(*columns).alias("a"))
    b = right.select(*key, F.struct(*columns).alias("b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    what = F.when(F.col("a").isNull(), F.array(F.lit("only right"))).when(F.col("b").isNull(), F.array(F.lit("only left"))).otherwise(changed)
    return a.join(b, key, "full").withColumn("changed", what).where(F.size("changed") > 0).select(*key, F.array_join("changed", ",").alias("changed"))


def rows_that_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted as often as they do."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def copy_attributes(points: DataFrame, source: DataFrame, columns: list[str], zero: bool = False) -> DataFrame:
    """columns from the source's point of the same gps_time and return_number (of several the least); without one they stay, or become 0."""
    own = source.where("gps_time IS NOT NULL").groupBy(F.col("gps_time").alias("__t"), F.col("return_number").alias("__r"))
    own = own.agg(F.min(F.struct(*columns)).alias("__v"))
    joined = points.join(own, (F.col("gps_time") == F.col("__t")) & (F.col("return_number") == F.col("__r")), "left")
    rest = {c: F.lit(0) if zero else F.col(c) for c in columns}
    new = {c: F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(rest[c]) for c in columns}
    return joined.withColumns(new).select(*points.columns)


def control(points: DataFrame, marks: DataFrame, step: float) -> DataFrame:
    """name, dz: control points (name, x, y, z) against the mean height of the points in the 3 x 3 cells around them."""
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    m = marks.withColumn("dc", near).withColumn("dr", near)
    m = m.select("name", "z", (F.floor(F.col("x") / step) + F.col("dc")).alias("mc"), (F.floor(F.col("y") / step) + F.col("dr")).alias("mr"))
    cells = points.groupBy(F.floor(xyz("x") / step).alias("col"), F.floor(xyz("y") / step).alias("row")).agg(F.sum(xyz("z")).alias("s"), F.count(F.lit(1)).alias("n"))
    met = m.join(cells, (F.col("mc") == F.col("col")) & (F.col("mr") == F.col("row")))
    return met.groupBy("name", "z").agg((F.sum("s") / F.sum("n")).alias("ground")).select("name", (F.col("ground") - F.col("z")).alias("dz"))


def control_on_surface(points: DataFrame, marks: DataFrame) -> DataFrame:
    """name, z, surface and dz: control points (name, x, y, z) against the triangulation of the points; surface and dz are null outside of it.

    Every mark is looked up in the triangle that holds it, in the triangulation of the whole cloud (`surface.heights_at`).
    """
    found = heights_at(tin(points), marks, ["name"])
    return marks.select("name", "z").join(found, "name", "left").select("name", "z", "surface", (F.col("surface") - F.col("z")).alias("dz"))


def adjust_z(points: DataFrame, control: DataFrame) -> DataFrame:
    """points lowered by the mean dz of the control points, as raw steps; without one on the surface they stay."""
    down = round((control.agg(F.avg("dz")).first()[0] or 0.0) / DEFAULT_SCALE.scale[2])
    return points.withColumn("zi", F.col("zi") - F.lit(down))


def track(points: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Adds track_z: the trajectory's height at the point's time, between its neighbours in time linearly.

    Both are put in order of time together, within each file, and every point looks at the
    trajectory's last row before and first row after it: one sort, no range join. The trajectory
    has source_file, gps_time and z. Points without a time have a null track_z.
    """
    side = points.where("gps_time IS NOT NULL").withColumns({"__t": F.lit(None).cast("double"), "__z": F.lit(None).cast("double")})
    rail = trajectory.select("source_file", "gps_time", F.col("gps_time").alias("__t"), F.col("z").cast("double").alias("__z"))
    both = side.withColumn("__p", F.lit(1)).unionByName(rail.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("source_file").orderBy("gps_time", "__p")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = {n: F.last(c, True).over(back) for n, c in (("__t0", "__t"), ("__z0", "__z"))} | {n: F.first(c, True).over(ahead) for n, c in (("__t1", "__t"), ("__z1", "__z"))}
    seen = both.withColumns(at).where("__p = 1")
    between = F.col("__z0") + (F.col("__z1") - F.col("__z0")) * (F.col("gps_time") - F.col("__t0")) / (F.col("__t1") - F.col("__t0"))
    value = F.when(F.col("__t1") > F.col("__t0"), between).otherwise(F.coalesce("__z0", "__z1"))
    timeless = points.where("gps_time IS NULL").withColumn("track_z", F.lit(None).cast("double"))
    return seen.withColumn("track_z", value).select(*points.columns, "track_z").unionByName(timeless)


def colour(points: DataFrame, raster: DataFrame, step: float) -> DataFrame:
    """red, green and blue from the raster (col, row, red, green, blue) cell of a point; without one they stay."""
    r = raster.select(F.col("col").alias("__c"), F.col("row").alias("__r"), *[F.col(c).alias(f"__{c}") for c in ("red", "green", "blue")])
    met = (F.floor(xyz("x") / step) == F.col("__c")) & (F.floor(xyz("y") / step) == F.col("__r"))
    joined = points.join(r, met, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in ("red", "green", "blue")}).select(*points.columns)


def apply_layers(points: DataFrame, edits: DataFrame, layers: int) -> DataFrame:
    """classification after the first `layers` of edits (source_file, point_index, layer, classification); the last edit of a point holds."""
    last = edits.where(F.col("layer") <= layers).groupBy("source_file", "point_index").agg(F.max_by("classification", "layer").alias("__c"))
    joined = points.join(last, ["source_file", "point_index"], "left")
    return joined.withColumn("classification", F.coalesce("__c", "classification")).select(*points.columns)
