"""Tiles, polygons, the quadtree index and sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.columns import morton
from pointlake.operators.filters import xyz


def tiles(points: DataFrame, size: float, buffer: float = 0.0) -> DataFrame:
    """tile_col, tile_row and is_buffer: every point once in its own tile, and again in each tile whose buffer holds it.

    At most four copies while the buffer is below half a tile. Write with partitionBy.
    """
    if not 0 <= buffer < size:
        raise ValueError("the buffer must be smaller than a tile")
    x, y = xyz("x"), xyz("y")
    own_c, own_r = F.floor(x / size), F.floor(y / size)
    reach = lambda v: F.sequence(F.floor((v - buffer) / size), F.floor((v + buffer) / size))
    out = points.withColumn("tile_col", F.explode(reach(x))).withColumn("tile_row", F.explode(reach(y)))
    return out.withColumn("is_buffer", (F.col("tile_col") != own_c) | (F.col("tile_row") != own_r))


def refine_tiles(points: DataFrame, size: float, most: int, levels: int = 6) -> DataFrame:
    """tile_level and tile_index: quadrants of a tile are split until none has over `most` points, up to `levels` times.

    Cells of the finest level are counted once; coarser counts are sums of those.
    """
    fine = size / 2**levels
    code = morton(F.floor(xyz("x") / fine), F.floor(xyz("y") / fine), 24)
    coded = points.withColumn("__m", code)
    counts = coded.groupBy("__m").agg(F.count(F.lit(1)).alias("n"))
    per_level = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    sums = per_level.groupBy("level", F.expr(f"shiftright(__m, 2 * ({levels} - level))").alias("i")).agg(F.sum("n").alias("n"))
    # the coarsest level at which a cell's quadrant fits
    fit = sums.where((F.col("n") <= most) | (F.col("level") == levels)).select("level", "i")
    asked = per_level.select("__m", "level", F.expr(f"shiftright(__m, 2 * ({levels} - level))").alias("i"))
    chosen = asked.join(fit, ["level", "i"]).groupBy("__m").agg(F.min("level").alias("tile_level"))
    return coded.join(chosen, "__m").withColumn("tile_index", F.expr(f"shiftright(__m, 2 * ({levels} - tile_level))")).drop("__m")


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over all rings: holes and islands come out right. At most a few thousand corners, as they are part of the plan."""
    crossings = F.lit(0)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y0 != y1:
                spans = (y >= min(y0, y1)) & (y < max(y0, y1))
                at = x0 + (y - y0) * ((x1 - x0) / (y1 - y0))
                crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def clip(points: DataFrame, rings: list[list[tuple[float, float]]], inside: bool = True) -> DataFrame:
    """Points inside (or outside) a polygon; the bounding box is tested first and reaches the scan."""
    xs, ys = [c[0] for r in rings for c in r], [c[1] for r in rings for c in r]
    x, y = xyz("x"), xyz("y")
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    within = box & in_polygon(x, y, rings)
    return points.where(within if inside else ~within)


def classify_inside(points: DataFrame, rings: list[list[tuple[float, float]]], to: int) -> DataFrame:
    within = in_polygon(xyz("x"), xyz("y"), rings)
    return points.withColumn("classification", F.when(within, to).otherwise(F.col("classification")))


def clip_many(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Points with `name` of each polygon they lie in; edges: name, x0, y0, x1, y1 of all polygons, any number of them.

    An edge matters to a point if it crosses the ray from the point to the right. Edges are dealt
    to the rows of cells that they span, and points to their polygon candidates by row; crossings
    are then counted, so the join is an equality on the row.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    points = points.withColumn("__id", F.monotonically_increasing_id())  # equal points are counted apart
    e = edges.where("y0 <> y1").withColumn("band", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    p = points.withColumn("__x", xyz("x")).withColumn("__y", xyz("y")).withColumn("band", F.floor(F.col("__y") / cell))
    at = F.col("x0") + (F.col("__y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    met = p.join(e, "band").where((F.col("__y") >= low) & (F.col("__y") < high) & (F.col("__x") < at))
    counted = met.groupBy("name", *points.columns).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where("__n % 2 = 1").drop("__id", "__n").select(*[c for c in points.columns if c != "__id"], "name")


def quadtree_cell(points: DataFrame, min_x: float, min_y: float, cell: float, levels: int) -> DataFrame:
    """Adds cell_index: the level's offset and the interleaved bits of the cell, lower left being zero."""
    offset = (4**levels - 1) // 3
    code = morton(F.floor((xyz("x") - min_x) / cell), F.floor((xyz("y") - min_y) / cell), levels)
    return points.withColumn("cell_index", code + offset)


def index_intervals(indexed: DataFrame, bridge: int = 0) -> DataFrame:
    """source_file, cell_index, first, last, full: runs of point numbers of each cell, gaps up to bridge taken in."""
    w = Window.partitionBy("source_file", "cell_index").orderBy("point_index")
    broken = F.coalesce(F.col("point_index") - F.lag("point_index").over(w) > bridge + 1, F.lit(False)).cast("int")
    runs = indexed.withColumn("__b", broken).withColumn("__r", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("source_file", "cell_index", "__r").agg(F.min("point_index").alias("first"), F.max("point_index").alias("last"), F.count(F.lit(1)).alias("full")).drop("__r")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """source_file, first, last: the union of intervals of all cells."""
    w = Window.partitionBy("source_file").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first") > reach + 1, F.lit(False)).cast("int")
    runs = intervals.withColumn("__f", fresh).withColumn("__r", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("source_file", "__r").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__r")


def sort_spatially(points: DataFrame, cell: float, partitions: int | None = None) -> DataFrame:
    """Points dealt and sorted along the Z-order curve of their cells: files then have tight bounds, which a reader prunes by."""
    coded = points.withColumn("__m", morton(F.floor(xyz("x") / cell), F.floor(xyz("y") / cell), 24))
    ranged = coded.repartitionByRange(partitions, "__m") if partitions else coded.repartitionByRange("__m")
    return ranged.sortWithinPartitions("__m", "source_file", "point_index").drop("__m")


def sort_by(points: DataFrame, *columns: str | Column) -> DataFrame:
    """By time, return, source or channel; ties by file and number."""
    return points.orderBy(*columns, "source_file", "point_index")


def multipoints(points: DataFrame, size: int) -> DataFrame:
    """source_file, record, coordinates: every `size` points of a file as one record, in their order."""
    record = points.withColumn("record", F.floor(F.col("point_index") / size))
    one = F.struct("point_index", xyz("x").alias("x"), xyz("y").alias("y"), xyz("z").alias("z"))
    packed = record.groupBy("source_file", "record").agg(F.array_sort(F.collect_list(one)).alias("p"))  # at most `size` points
    return packed.select("source_file", "record", F.transform("p", lambda p: F.struct(p.x, p.y, p.z)).alias("coordinates"))


def planes(points: DataFrame, step: float) -> DataFrame:
    """col, row, n and the eigenvalues e1 >= e2 >= e3 of each cell's covariance, in closed form from moments."""
    import math

    c = points.select(F.floor(xyz("x") / step).alias("col"), F.floor(xyz("y") / step).alias("row"), *[xyz(a).alias(a) for a in "xyz"])
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = c.groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).where("n >= 3")
    xx, xy, xz, yy, yz, zz = (F.col(a + b) for a, b in pairs)
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * off) / 6)
    a, b, d = xx - q, yy - q, zz - q
    det = a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))
    angle = F.acos(r) / 3
    out = m.withColumns({"q": q, "p": p, "t": angle})
    e1 = F.col("q") + 2 * F.col("p") * F.cos("t")
    e3 = F.col("q") + 2 * F.col("p") * F.cos(F.col("t") + 2 * math.pi / 3)
    return out.select("col", "row", "n", e1.alias("e1"), (3 * F.col("q") - e1 - e3).alias("e2"), e3.alias("e3"))
