"""Queries of the index, of whole workflows, and of points as a view, with the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators import raster, spatial, workflows
from pointlake.operators import index as quadtree
from pointlake.operators.filters import FILTERS
from pointlake.plans.point_cases import X, Y, Z, points_sql
from pointlake.plans.surface_cases import scratch
from pointlake.plans.tool_cases import AS_CELL
from pointlake.plans.tool_cases import ORACLE_SQL as TOOL_SQL
from pointlake.schema import lineitem_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_K = "source_file, point_index"


# --- index
def _region(keep: str, args: tuple[float, ...], shape: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        points = lineitem_points(spark, sf)
        tree = quadtree.Quadtree.of(points, 64.0)
        cells = getattr(tree, shape)(spark, *args)
        return quadtree.points_of(tree.indexed(points), cells).where(FILTERS[keep](*args)).select("source_file", "point_index")

    return query


QUERIES["index_rectangle"] = _region("keep_xy", (200.0, 100.0, 900.0, 400.0), "rectangle")
ORACLE_SQL["index_rectangle"] = points_sql(f"SELECT {_K} FROM pts WHERE {X} >= 200 AND {X} < 900 AND {Y} >= 100 AND {Y} < 400")
QUERIES["index_circle"] = _region("keep_circle", (1000.0, 300.0, 150.0), "circle")
ORACLE_SQL["index_circle"] = points_sql(f"SELECT {_K} FROM pts WHERE ({X} - 1000) * ({X} - 1000) + ({Y} - 300) * ({Y} - 300) < 22500")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    points = lineitem_points(spark, sf)
    tree = quadtree.Quadtree.of(points, 64.0)
    counted = tree.indexed(points).groupBy("cell_code").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns(tree.box(F.col("cell_code"))).select("cell_min_x", "cell_min_y", "cell_max_x", "cell_max_y", "n")


QUERIES["index_cell_boxes"] = _boxes
ORACLE_SQL["index_cell_boxes"] = points_sql(
    f"SELECT floor({X} / 64) * 64 AS cell_min_x, floor({Y} / 64) * 64 AS cell_min_y, floor({X} / 64) * 64 + 64 AS cell_max_x, floor({Y} / 64) * 64 + 64 AS cell_max_y, count(*) AS n FROM pts GROUP BY ALL"
)


def _tree_of(spark: SparkSession, sf: str) -> tuple[quadtree.Quadtree, DataFrame]:
    tree = quadtree.Quadtree.tiling(0.0, 0.0, 32768.0, 10)
    return tree, tree.indexed(lineitem_points(spark, sf))


_ADAPTED_LEAST, _ADAPTED_LEVELS = 1500, 10


def _adapted_sql() -> str:
    """Merged level by level: a cell takes the place of its four quadrants if all are cells and hold fewer points than the least."""
    bits = lambda v: " + ".join(f"((CAST(floor({v} / 32) AS BIGINT) >> {k} & 1) << {2 * k})" for k in range(_ADAPTED_LEVELS))
    steps = [f"m{_ADAPTED_LEVELS} AS (SELECT {bits(X)} + (({bits(Y)}) << 1) AS code, count(*) AS n FROM pts GROUP BY 1)"]
    for level in range(_ADAPTED_LEVELS - 1, -1, -1):
        steps.append(f"m{level} AS (SELECT code >> 2 AS code, CAST(sum(n) AS BIGINT) AS n FROM m{level + 1} GROUP BY 1 HAVING count(*) = 4 AND sum(n) < {_ADAPTED_LEAST})")
    left = [f"SELECT {level} AS level, code, n FROM m{level}" + (f" WHERE code >> 2 NOT IN (SELECT code FROM m{level - 1})" if level else "") for level in range(_ADAPTED_LEVELS + 1)]
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(left)}"


def _adapted(spark: SparkSession, sf: str) -> DataFrame:
    tree, indexed = _tree_of(spark, sf)
    return tree.adapted(indexed, _ADAPTED_LEAST)


def _adapted_region(spark: SparkSession, sf: str, shape: str, *args: float) -> DataFrame:
    tree, indexed = _tree_of(spark, sf)
    met = getattr(tree, f"meeting_{shape}")(tree.adapted(indexed, _ADAPTED_LEAST), *args)
    return met.select("level", "code", "n", tree.cell_index(F.col("level"), F.col("code")).alias("cell_index"))


QUERIES["index_adaptive"] = _adapted
ORACLE_SQL["index_adaptive"] = points_sql(_adapted_sql())
_SIDES = {a: " + ".join(f"((code >> {2 * k + odd} & 1) << {k})" for k in range(_ADAPTED_LEVELS)) for odd, a in enumerate("xy")}
_BOXED = f"SELECT *, 32768.0 / (1 << level) AS size, ({_SIDES['x']}) * 32768.0 / (1 << level) AS ax, ({_SIDES['y']}) * 32768.0 / (1 << level) AS ay FROM ({_adapted_sql()})"
_CELL_INDEX = "CAST(((CAST(1 AS BIGINT) << (2 * level)) - 1) // 3 + code AS BIGINT) AS cell_index"
QUERIES["index_adaptive_rectangle"] = lambda spark, sf: _adapted_region(spark, sf, "rectangle", 200.0, 96.0, 900.0, 416.0)
ORACLE_SQL["index_adaptive_rectangle"] = points_sql(f"SELECT level, code, n, {_CELL_INDEX} FROM ({_BOXED}) WHERE ax < 900 AND ax + size > 200 AND ay < 416 AND ay + size > 96")
QUERIES["index_adaptive_circle"] = lambda spark, sf: _adapted_region(spark, sf, "circle", 1000.0, 300.0, 150.0)
ORACLE_SQL["index_adaptive_circle"] = points_sql(
    f"SELECT level, code, n, {_CELL_INDEX} FROM ({_BOXED}) WHERE pow(greatest(ax - 1000, 1000 - ax - size, 0), 2) + pow(greatest(ay - 300, 300 - ay - size, 0), 2) < 22500"
)
QUERIES["index_rectangle_cells"] = lambda spark, sf: _tree_of(spark, sf)[0].rectangle(spark, 200.0, 96.0, 900.0, 416.0).select("col", "row").join(
    _tree_of(spark, sf)[1].select(F.floor(F.col("xi") * 0.01 / 32).alias("col"), F.floor(F.col("yi") * 0.01 / 32).alias("row")), ["col", "row"], "left"
).groupBy("col", "row").agg(F.count(F.lit(1)).alias("rows"))
ORACLE_SQL["index_rectangle_cells"] = points_sql(f"""SELECT c.col, r.row, count(*) AS rows FROM (SELECT unnest(range(6, 29)) AS col) AS c CROSS JOIN (SELECT unnest(range(3, 13)) AS row) AS r
    LEFT JOIN (SELECT CAST(floor({X} / 32) AS BIGINT) AS col, CAST(floor({Y} / 32) AS BIGINT) AS row FROM pts) AS p ON p.col = c.col AND p.row = r.row GROUP BY 1, 2""")


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.index_intervals(spatial.quadtree_cell(lineitem_points(spark, sf), 0.0, 0.0, 64.0, 6), 5)


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)[1]
    quadtree.save_index(_intervals(spark, sf), path)
    return quadtree.load_index(spark, path)


QUERIES["index_saved"] = _saved
ORACLE_SQL["index_saved"] = TOOL_SQL["index_intervals"]
QUERIES["index_limited_intervals"] = lambda spark, sf: quadtree.limit_intervals(_intervals(spark, sf), 100)
_SPANS = TOOL_SQL["index_intervals"]
ORACLE_SQL["index_limited_intervals"] = f"""WITH v AS ({_SPANS}), g AS (SELECT *, first - lag(last) OVER (PARTITION BY source_file, cell_index ORDER BY first) AS gap FROM v),
    c AS (SELECT source_file, count(DISTINCT cell_index) AS cells FROM v GROUP BY 1),
    k AS (SELECT g.*, CASE WHEN gap IS NOT NULL AND row_number() OVER (PARTITION BY source_file ORDER BY gap DESC NULLS LAST, cell_index, first) <= 100 - cells THEN 1 ELSE 0 END AS b FROM g JOIN c USING (source_file)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY source_file, cell_index ORDER BY first ROWS UNBOUNDED PRECEDING) AS run FROM k)
    SELECT source_file, cell_index, min(first) AS first, max(last) AS last, CAST(sum("full") AS BIGINT) AS "full" FROM s GROUP BY source_file, cell_index, run"""
ORACLE_SQL["index_merged_intervals"] = f"""WITH v AS ({_SPANS}),
    m AS (SELECT *, max(last) OVER (PARTITION BY source_file ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WHERE cell_index % 3 = 0),
    s AS (SELECT *, sum(CASE WHEN first > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT source_file, min(first) AS first, max(last) AS last FROM s GROUP BY source_file, run"""


# --- workflows
def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    return workflows.normalize(lineitem_points(spark, sf))


QUERIES["workflow_ground"] = lambda spark, sf: workflows.with_ground(lineitem_points(spark, sf), 40.0, 30.0).select("source_file", "point_index", "classification")
QUERIES["workflow_terrain"] = lambda spark, sf: workflows.terrain_model(lineitem_points(spark, sf), 10.0)
QUERIES["workflow_surface"] = lambda spark, sf: workflows.surface_model(lineitem_points(spark, sf), 10.0)
QUERIES["workflow_normalized"] = lambda spark, sf: _normalized(spark, sf).select("source_file", "point_index", "zi")
QUERIES["workflow_canopy"] = lambda spark, sf: workflows.canopy_model(_normalized(spark, sf), 10.0, 5.0)
QUERIES["workflow_canopy_pit_free"] = lambda spark, sf: workflows.pit_free_canopy_model(_normalized(spark, sf), 10.0, 5.0, (0.0, 50.0, 200.0, 400.0), 40.0)
QUERIES["workflow_remove_duplicates"] = lambda spark, sf: workflows.remove_duplicates(lineitem_points(spark, sf)).select("source_file", "point_index", "zi")
ORACLE_SQL["workflow_remove_duplicates"] = TOOL_SQL["duplicates_xyz"]


def _order(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows the sorted table has, and how many of them come before the one in front of them; by partition and between partitions."""
    from pyspark.sql import Window

    late = F.coalesce("gps_time", F.lit(float("inf"))).alias("gps_time")  # points without a time come last
    rows = workflows.sort_in_time(lineitem_points(spark, sf)).select(late, F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    inside = rows.withColumn("back", F.col("gps_time") < F.lag("gps_time").over(Window.partitionBy("part").orderBy("at")))
    parts = inside.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("back"), F.min("gps_time").alias("low"), F.max("gps_time").alias("high"))
    parts = parts.withColumn("cut", F.col("low") < F.lag("high").over(Window.orderBy("part")))  # a row a partition
    return parts.agg(F.sum("n").alias("n"), (F.sum("back") + F.count_if("cut")).alias("out_of_order"))


QUERIES["workflow_sort_in_time"] = _order
ORACLE_SQL["workflow_sort_in_time"] = points_sql("SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM pts")
QUERIES["workflow_quality_report"] = lambda spark, sf: workflows.quality_report(lineitem_points(spark, sf), 50.0)
ORACLE_SQL["workflow_quality_report"] = f"""WITH v AS ({TOOL_SQL["validate"]}), o AS ({TOOL_SQL["occupancy"]}), l AS ({TOOL_SQL["overlap"]})
    SELECT concat('failed: ', rule) AS item, CAST(failed AS DOUBLE) AS value FROM v UNION ALL SELECT 'points', CAST(points AS DOUBLE) FROM o UNION ALL SELECT 'cells', CAST(cells AS DOUBLE) FROM o
    UNION ALL SELECT 'density', density FROM o UNION ALL SELECT 'most lines in a cell', CAST(max(lines) AS DOUBLE) FROM l UNION ALL SELECT 'cells with several lines', CAST(count(*) FILTER (lines > 1) AS DOUBLE) FROM l"""
QUERIES["raster_difference"] = lambda spark, sf: workflows.raster_difference(*(raster.grid(lineitem_points(spark, sf), 50.0, s) for s in ("highest", "lowest")))
ORACLE_SQL["raster_difference"] = points_sql(f"SELECT {AS_CELL}, max({Z}) - min({Z}) AS value FROM pts GROUP BY 1, 2")


# --- points as a view
def _view(spark: SparkSession, sf: str) -> DataFrame:
    workflows.point_view(lineitem_points(spark, sf))
    return spark.sql("""SELECT classification, return_number, count(*) AS n, max(z) AS z, count(DISTINCT point_source_id) AS lines FROM points
        GROUP BY GROUPING SETS ((classification, return_number), (classification), ())""")


QUERIES["sql_points"] = _view
ORACLE_SQL["sql_points"] = points_sql(f"""SELECT classification, return_number, count(*) AS n, max({Z}) AS z, count(DISTINCT point_source_id) AS lines FROM pts
    GROUP BY GROUPING SETS ((classification, return_number), (classification), ())""")
