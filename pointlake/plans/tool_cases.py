"""Queries of the whole-cloud operators, with the SQL to compare with."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators import aggregates, cleaning, flightlines, matching, raster, spatial
from pointlake.operators.filters import FILTERS, xyz
from pointlake.operators.transforms import map_values
from pointlake.plans.point_cases import X, Y, Z, points_sql
from pointlake.schema import ScaleOffset, lineitem_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = f"floor({X} / 50.0)", f"floor({Y} / 50.0)"
AS_CELL = f"CAST({CELL[0]} AS BIGINT) AS col, CAST({CELL[1]} AS BIGINT) AS row"


def _case(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf: query(lineitem_points(spark, sf))
    if sql:
        ORACLE_SQL[name] = points_sql(sql)


_case(
    "lowest_ground_by_cell",
    lambda p: cleaning.lowest_by_cell(p.where(FILTERS["keep_class"](2) & FILTERS["keep_xy"](0, 0, 1500, 900)), 50),
    f"""SELECT CAST({CELL[0]} AS BIGINT) AS cx, CAST({CELL[1]} AS BIGINT) AS cy, min(zi) AS lowest_zi, count(*) AS n FROM pts
    WHERE classification = 2 AND {X} >= 0 AND {X} < 1500 AND {Y} >= 0 AND {Y} < 900 GROUP BY 1, 2""",
)
_case("inventory", aggregates.inventory, """SELECT source_file, count(*) AS n, count(*) FILTER (return_number = 1) AS return_1,
    count(*) FILTER (return_number = 2) AS return_2, count(*) FILTER (return_number = 3) AS return_3, count(*) FILTER (return_number = 4) AS return_4,
    count(*) FILTER (return_number = 5) AS return_5, min(xi) AS min_xi, max(xi) AS max_xi, min(yi) AS min_yi, max(yi) AS max_yi,
    min(zi) AS min_zi, max(zi) AS max_zi FROM pts GROUP BY 1""")  # fmt: skip
_case("summary", aggregates.summary, " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, count({c}) AS filled FROM pts" for c in aggregates.SUMMARY_FIELDS))
for _c in ("classification", "ext_classification", "return_number", "number_of_returns"):
    _case(f"counts_{_c}", lambda p, c=_c: aggregates.counts_by(p, c), f"SELECT {_c} AS value, count(*) AS n FROM pts GROUP BY 1")
_flags = ("synthetic_flag", "keypoint_flag", "withheld_flag", "overlap_flag", "edge_of_flight_line")
_case("flag_counts", aggregates.flag_counts, "SELECT " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in _flags) + " FROM pts")

#: histogram: (Spark column, SQL, step)
HISTOGRAMS = {
    "x": (lambda: xyz("x"), X, 25.0), "y": (lambda: xyz("y"), Y, 25.0), "z": (lambda: xyz("z"), Z, 50.0),
    **{c: ((lambda c=c: F.col(c)), c, s) for c, s in (
        ("xi", 1000.0), ("yi", 1000.0), ("zi", 5000.0), ("intensity", 256.0), ("classification", 1.0), ("scan_angle_rank", 5.0),
        ("return_number", 1.0), ("number_of_returns", 1.0), ("user_data", 4.0), ("point_source_id", 8.0), ("gps_time", 8388608.0),
        ("scanner_channel", 1.0), ("red", 1024.0), ("green", 1024.0), ("blue", 1024.0), ("nir", 1024.0), ("attr_0", 0.5), ("attr_1", 0.5),
        ("wave_index", 1.0), ("ext_classification", 1.0))},
}


def _hist_sql(v: str, step: float, mean: str | None = None, where: str = "") -> str:
    value = f"CAST({v} AS DOUBLE)"
    other = f"CAST({mean or v} AS DOUBLE)"
    return f"SELECT CAST(floor({value} * CAST({1.0 / step!r} AS DOUBLE)) AS BIGINT) AS bin, count({other}) AS n, avg({other}) AS mean FROM pts WHERE {v} IS NOT NULL GROUP BY 1"


for _name, (_col, _sql, _step) in HISTOGRAMS.items():
    _case(f"histogram_{_name}", lambda p, c=_col, s=_step: aggregates.histogram(p, c(), s), _hist_sql(_sql, _step))
for _a, _b in (("classification", "intensity"), ("classification", "scan_angle_rank"), ("scan_angle_rank", "zi"), ("scan_angle_rank", "number_of_returns"), ("scan_angle_rank", "intensity")):
    _case(f"histogram_avg_{_a}_{_b}", lambda p, a=_a, b=_b: aggregates.histogram_of_mean(p, F.col(a), 1.0, F.col(b)), _hist_sql(_a, 1.0, _b))
_map = "(number_of_returns * (number_of_returns - 1) / 2 + return_number - 1)"
_case("histogram_avg_return_map_intensity", lambda p: aggregates.histogram_of_mean(p, F.expr(_map), 1.0, F.col("intensity")), _hist_sql(_map, 1.0, "intensity"))
_case("histogram_clamped", lambda p: aggregates.histogram(p, F.col("intensity"), 100.0, 500, 2000),
      _hist_sql("greatest(500.0, least(2000.0, CAST(intensity AS DOUBLE)))", 100.0))
_case("fluff", aggregates.fluff, " UNION ALL ".join(
    f"SELECT '{a}' AS axis, " + ", ".join(f"min({a} % {10**k}) = max({a} % {10**k}) AS fluff_{10**k}" for k in range(1, 5)) + " FROM pts" for a in ("xi", "yi", "zi")))
_case("occupancy", lambda p: aggregates.occupancy(p, 50.0), f"""WITH c AS (SELECT {AS_CELL}, count(*) AS n FROM pts GROUP BY 1, 2)
    SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, min(col) AS min_cx, max(col) AS max_cx, min(row) AS min_cy, max(row) AS max_cy,
    count(*) * CAST(2500 AS DOUBLE) AS area, CAST(sum(n) AS DOUBLE) / (count(*) * CAST(2500 AS DOUBLE)) AS density FROM c""")  # fmt: skip
_case("gps_weeks", aggregates.gps_weeks, "SELECT CAST(floor(gps_time / 604800 + CAST(1653.4391534391534 AS DOUBLE)) AS BIGINT) AS week, count(*) AS n FROM pts WHERE gps_time IS NOT NULL GROUP BY 1")
_case("precision", aggregates.precision, "SELECT diff, count(*) AS n FROM (SELECT xi - lag(xi) OVER (ORDER BY xi) AS diff FROM pts) WHERE diff IS NOT NULL GROUP BY 1")
_rules = {"return number is zero": "return_number < 1", "number of returns is zero": "number_of_returns < 1", "return number over number of returns": "return_number > number_of_returns",
          "class over 31 in the legacy field": "classification > 31", "scan angle beyond 90 degrees": "abs(scan_angle_rank) > 90", "no gps time": "gps_time IS NULL"}
_case("validate", aggregates.validate, " UNION ALL ".join(
    f"SELECT '{r}' AS rule, count(*) FILTER ({c}) AS failed, CASE WHEN count(*) FILTER ({c}) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM pts" for r, c in _rules.items()))

# --- rasters
_agg = {"highest": f"max({Z})", "lowest": f"min({Z})", "average": f"avg({Z})", "stddev": f"stddev_pop({Z})", "range": f"max({Z}) - min({Z})", "counter": "CAST(count(*) AS DOUBLE)"}
for _name, _sql in _agg.items():
    _case(f"grid_{_name}", lambda p, n=_name: raster.grid(p, 50.0, n), f"SELECT {AS_CELL}, {_sql} AS value FROM pts GROUP BY 1, 2")
_case("grid_point_density", lambda p: raster.grid_density(p, 50.0), f"SELECT {AS_CELL}, count(*) / CAST(2500 AS DOUBLE) AS value FROM pts GROUP BY 1, 2")
_case("grid_pulse_density", lambda p: raster.grid_pulse_density(p, 50.0), f"SELECT {AS_CELL}, count(*) / CAST(2500 AS DOUBLE) AS value FROM pts WHERE return_number >= number_of_returns GROUP BY 1, 2")
_case("grid_scan_angle_lowest", lambda p: raster.grid_scan_angle_lowest(p, 50.0), f"SELECT {AS_CELL}, CAST(min(abs(scan_angle_rank)) AS DOUBLE) AS value FROM pts GROUP BY 1, 2")
_case("grid_intensity_average", lambda p: raster.grid(p, 50.0, "average", F.col("intensity")), f"SELECT {AS_CELL}, avg(intensity) AS value FROM pts GROUP BY 1, 2")
_case("grid_majority", lambda p: raster.grid_majority(p, 50.0), f"""SELECT col, row, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY n DESC, v) AS k
    FROM (SELECT {AS_CELL}, classification AS v, count(*) AS n FROM pts GROUP BY 1, 2, 3)) WHERE k = 1""")  # fmt: skip
_case("grid_fill", lambda p: raster.fill(raster.grid(p.where("zi % 3 = 0"), 50.0, "highest")), f"""WITH g AS (SELECT {AS_CELL}, max({Z}) AS value FROM pts WHERE zi % 3 = 0 GROUP BY 1, 2),
    o AS (SELECT col + dc AS col, row + dr AS row, value, dc = 0 AND dr = 0 AS own FROM g, (VALUES (-1), (0), (1)) AS a(dc), (VALUES (-1), (0), (1)) AS b(dr))
    SELECT col, row, coalesce(max(value) FILTER (own), avg(value)) AS value FROM o GROUP BY 1, 2""")  # fmt: skip
QUERIES["grid_subcircle_highest"] = lambda spark, sf: raster.grid_subcircle_highest(lineitem_points(spark, sf), 50.0, 5.0)
_ring = [(0.0, 0.0), *((5.0 * math.cos(k * math.pi / 4), 5.0 * math.sin(k * math.pi / 4)) for k in range(8))]
ORACLE_SQL["grid_subcircle_highest"] = points_sql(f"""SELECT CAST(floor(({X} + dx) / 50) AS BIGINT) AS col, CAST(floor(({Y} + dy) / 50) AS BIGINT) AS row, max({Z}) AS value
    FROM pts, (VALUES {", ".join(f"(CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for a, b in _ring)}) AS s(dx, dy) GROUP BY 1, 2""")
_up = f"CASE WHEN {Z} > 300 THEN {Z} END"
_first = "return_number <= 1"
_skew = f"avg(pow({Z} - m, 3)) / pow(stddev_pop({Z}), 3)"
_case("canopy_heights", lambda p: raster.canopy(p, 200.0, 300.0).select("col", "row", "n", "min", "max", "avg", "std", "qav", "p25", "p50", "p95", "cov", "dns", "gap"),
      f"""SELECT CAST(floor({X} / 200.0) AS BIGINT) AS col, CAST(floor({Y} / 200.0) AS BIGINT) AS row, count(*) AS n, min({_up}) AS min, max({_up}) AS max, avg({_up}) AS avg,
      stddev_pop({_up}) AS std, sqrt(avg({_up} * {_up})) AS qav, quantile_cont({_up}, 0.25) AS p25, quantile_cont({_up}, 0.5) AS p50, quantile_cont({_up}, 0.95) AS p95,
      100.0::DOUBLE * count(*) FILTER ({Z} > 300 AND {_first}) / nullif(count(*) FILTER ({_first}), 0) AS cov, 100.0::DOUBLE * count(*) FILTER ({Z} > 300) / count(*) AS dns,
      100.0::DOUBLE - 100.0::DOUBLE * count(*) FILTER ({Z} > 300 AND {_first}) / nullif(count(*) FILTER ({_first}), 0) AS gap FROM pts GROUP BY 1, 2""")  # fmt: skip
_case("canopy_moments", lambda p: raster.canopy(p, 500.0, 300.0, bincentiles=()).where("n > 20").select("col", "row", F.round("ske", 6).alias("ske"), F.round("kur", 6).alias("kur")),
      f"""WITH c AS (SELECT CAST(floor({X} / 500.0) AS BIGINT) AS col, CAST(floor({Y} / 500.0) AS BIGINT) AS row, {_up} AS h FROM pts),
      m AS (SELECT *, avg(h) OVER (PARTITION BY col, row) AS m, count(*) OVER (PARTITION BY col, row) AS n FROM c)
      SELECT col, row, round(avg(pow(h - m, 3)) / pow(stddev_pop(h), 3), 6) AS ske, round(avg(pow(h - m, 4)) / pow(stddev_pop(h), 4), 6) AS kur FROM m WHERE n > 20 GROUP BY 1, 2""")  # fmt: skip
_case("canopy_counts", lambda p: raster.canopy(p, 200.0, 300.0, (), (), (0.0, 200.0, 500.0, 2000.0)).select("col", "row", "c00", "c01", "c02", "d00", "d01", "d02"),
      f"SELECT CAST(floor({X} / 200.0) AS BIGINT) AS col, CAST(floor({Y} / 200.0) AS BIGINT) AS row, " + ", ".join(
          f"count(*) FILTER ({Z} >= {a} AND {Z} < {b}) AS c0{i}, 100.0::DOUBLE * count(*) FILTER ({Z} >= {a} AND {Z} < {b}) / count(*) AS d0{i}"
          for i, (a, b) in enumerate(((0, 200), (200, 500), (500, 2000)))) + " FROM pts GROUP BY 1, 2")
_case("canopy_bincentiles", lambda p: raster.canopy(p, 200.0, 300.0, (), (50, 80)).select("col", "row", "b50", "b80"),
      f"""WITH c AS (SELECT CAST(floor({X} / 200.0) AS BIGINT) AS col, CAST(floor({Y} / 200.0) AS BIGINT) AS row, {Z} AS h FROM pts),
      t AS (SELECT *, max(CASE WHEN h > 300 THEN h END) OVER (PARTITION BY col, row) AS top FROM c)
      SELECT col, row, 100.0::DOUBLE * count(*) FILTER (h > 300 AND h < top * 0.5::DOUBLE) / nullif(count(*) FILTER (h > 300), 0) AS b50,
      100.0::DOUBLE * count(*) FILTER (h > 300 AND h < top * 0.8::DOUBLE) / nullif(count(*) FILTER (h > 300), 0) AS b80 FROM t GROUP BY 1, 2""")  # fmt: skip


def _circles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a", 300.0, 200.0, 60.0), ("b", 310.0, 210.0, 80.0), ("c", 900.0, 400.0, 50.0)], "name string, cx double, cy double, radius double")


QUERIES["canopy_plots"] = lambda spark, sf: raster.plots(lineitem_points(spark, sf), _circles(spark), 300.0)
ORACLE_SQL["canopy_plots"] = points_sql(f"""SELECT name, count(*) AS n, max({_up}) AS max, avg({_up}) AS avg FROM pts,
    (VALUES ('a', 300.0, 200.0, 60.0), ('b', 310.0, 210.0, 80.0), ('c', 900.0, 400.0, 50.0)) AS c(name, cx, cy, r)
    WHERE pow({X} - cx, 2) + pow({Y} - cy, 2) < r * r GROUP BY 1""")

# --- cleaning
_K = "source_file, point_index"
for _which, _by in (("lowest", "zi"), ("highest", "zi DESC")):
    _case(f"thin_{_which}", lambda p, w=_which: cleaning.thin_by_cell(p, 50.0, w).select("cx", "cy", "zi", "source_file", "point_index"),
          f"""SELECT cx, cy, zi, {_K} FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY {_by}, {_K}) AS k FROM
          (SELECT *, CAST(floor({X} / 50.0 + 0.5) AS BIGINT) AS cx, CAST(floor({Y} / 50.0 + 0.5) AS BIGINT) AS cy FROM pts)) WHERE k = 1""")  # fmt: skip
QUERIES["thin_random"] = lambda spark, sf: cleaning.thin_by_cell(lineitem_points(spark, sf), 50.0, "random").select("cx", "cy", "zi")
_dup = f"SELECT {_K}, zi FROM (SELECT *, row_number() OVER (PARTITION BY {{on}} ORDER BY {{by}}{_K}) AS k FROM pts) WHERE k {{what}} 1"
_case("duplicates_xy", lambda p: cleaning.drop_duplicates(p).select("source_file", "point_index", "zi"), _dup.format(on="xi, yi", by="", what="="))
_case("duplicates_xyz", lambda p: cleaning.drop_duplicates(p, ("xi", "yi", "zi")).select("source_file", "point_index", "zi"), _dup.format(on="xi, yi, zi", by="", what="="))
_case("duplicates_lowest_z", lambda p: cleaning.drop_duplicates(p, lowest_z=True).select("source_file", "point_index", "zi"), _dup.format(on="xi, yi", by="zi, ", what="="))
_case("duplicates_removed", lambda p: cleaning.removed_duplicates(p).select("source_file", "point_index", "zi"), _dup.format(on="xi, yi", by="", what=">"))
_case("duplicates_flagged", lambda p: cleaning.flag_duplicates(p).select("source_file", "point_index", "withheld_flag"),
      f"SELECT {_K}, CASE WHEN k > 1 THEN 1 ELSE withheld_flag END AS withheld_flag FROM (SELECT *, row_number() OVER (PARTITION BY xi, yi ORDER BY {_K}) AS k FROM pts)")


def _q(v: str, step: str) -> str:
    return f"CAST(floor({v} / {step} + 0.5) AS BIGINT)"


_offsets = ", ".join(f"(VALUES (-1), (0), (1)) AS {t}(d{t})" for t in "abc")
_case("duplicates_nearby", lambda p: cleaning.drop_nearby(p, 20.0).select("source_file", "point_index", "zi"), f"""WITH q AS (SELECT *, {_q(X, '20.0')} AS qx, {_q(Y, '20.0')} AS qy, {_q(Z, '20.0')} AS qz,
    row_number() OVER (ORDER BY {_K}) AS o FROM pts), c AS (SELECT qx, qy, qz, min(o) AS o FROM q GROUP BY ALL),
    m AS (SELECT qx + da AS qx, qy + db AS qy, qz + dc AS qz, min(o) AS f FROM c, {_offsets} GROUP BY 1, 2, 3)
    SELECT {_K}, zi FROM q JOIN m USING (qx, qy, qz) WHERE q.o = m.f""")  # fmt: skip
_case("noise_isolated", lambda p: cleaning.mark_noise(p, 40.0, 5).where("is_noise").select("source_file", "point_index", "zi"), f"""WITH q AS (SELECT *, floor({X} / 40.0) AS qx, floor({Y} / 40.0) AS qy, floor({Z} / 40.0) AS qz FROM pts),
    c AS (SELECT qx, qy, qz, count(*) AS n FROM q GROUP BY ALL), m AS (SELECT qx + da AS qx, qy + db AS qy, qz + dc AS qz, sum(n) AS n FROM c, {_offsets} GROUP BY 1, 2, 3)
    SELECT {_K}, zi FROM q JOIN m USING (qx, qy, qz) WHERE m.n <= 5""")  # fmt: skip
_case("voxels", lambda p: cleaning.voxels(p, 50.0), f"""SELECT CAST({CELL[0]} AS BIGINT) AS vx, CAST({CELL[1]} AS BIGINT) AS vy, CAST(floor({Z} / 50.0) AS BIGINT) AS vz,
    count(*) AS n, avg(intensity) AS intensity FROM pts GROUP BY 1, 2, 3""")  # fmt: skip

# --- flight lines and returns
_case("overlap", lambda p: flightlines.overlap(p, 50.0), f"""SELECT col, row, count(*) AS lines, max(low) - min(low) AS low_spread, max(high) - min(high) AS high_spread, max(n) - min(n) AS count_spread
    FROM (SELECT {AS_CELL}, point_source_id, min(zi) AS low, max(zi) AS high, count(*) AS n FROM pts GROUP BY 1, 2, 3) GROUP BY 1, 2""")  # fmt: skip
_case("overage", lambda p: flightlines.overage(p, 50.0).where("is_overage").select("source_file", "point_index", "zi"), f"""WITH c AS (SELECT *, {AS_CELL} FROM pts),
    l AS (SELECT col, row, point_source_id AS line, min(abs(scan_angle_rank)) AS a FROM c GROUP BY 1, 2, 3), b AS (SELECT col, row, first_value(line) OVER (PARTITION BY col, row ORDER BY a, line) AS best FROM l)
    SELECT {_K}, zi FROM c JOIN (SELECT DISTINCT col, row, best FROM b) USING (col, row) WHERE point_source_id <> best""")  # fmt: skip
_gap = "lag(gps_time) OVER (PARTITION BY source_file ORDER BY gps_time, point_index)"
_case("recover_flightlines", lambda p: flightlines.recover_flightlines(p, 1e6).select("source_file", "point_index", "line"), f"""SELECT {_K}, CAST(sum(j) OVER (PARTITION BY source_file ORDER BY gps_time, point_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line
    FROM (SELECT *, CASE WHEN gps_time - {_gap} > 1e6 THEN 1 ELSE 0 END AS j FROM pts WHERE gps_time IS NOT NULL)""")  # fmt: skip
for _c, _i in (("classification", None), ("point_source_id", None), ("intensity", 500.0), ("gps_time", 1e7), ("user_data", 10.0), ("scan_angle_rank", 10.0)):
    _part = f"CAST({_c} AS BIGINT)" if _i is None else f"CAST(floor({_c} / CAST({_i} AS DOUBLE)) AS BIGINT)"
    _case(f"split_{_c}", lambda p, c=_c, i=_i: flightlines.split(p, c, i).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("zi").alias("z")),
          f"SELECT {_part} AS part, count(*) AS n, CAST(sum(zi) AS BIGINT) AS z FROM pts GROUP BY 1")
_case("split_every", lambda p: flightlines.split_every(p, 100).groupBy("source_file", "part").agg(F.count(F.lit(1)).alias("n")), "SELECT source_file, point_index // 100 AS part, count(*) AS n FROM pts GROUP BY 1, 2")
_case("repair_number_of_returns", lambda p: flightlines.repair_number_of_returns(p).select("source_file", "point_index", "number_of_returns"),
      f"SELECT {_K}, CASE WHEN gps_time IS NULL THEN number_of_returns ELSE max(return_number) OVER (PARTITION BY source_file, gps_time) END AS number_of_returns FROM pts")
_case("check_return_numbering", flightlines.check_returns, """SELECT CASE WHEN d < n THEN 'repeated' WHEN d < m THEN 'missing' ELSE 'complete' END AS state, count(*) AS pulses FROM
    (SELECT source_file, gps_time, count(*) AS n, count(DISTINCT return_number) AS d, max(number_of_returns) AS m FROM pts WHERE gps_time IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
_case("return_distance_histogram", lambda p: flightlines.return_distances(p, 10.0), """SELECT CAST(floor(fall / 10.0) AS BIGINT) AS bin, count(*) AS n FROM
    (SELECT (lag(zi) OVER (PARTITION BY source_file, gps_time ORDER BY return_number, point_index) - zi) * CAST(0.01 AS DOUBLE) AS fall FROM pts WHERE gps_time IS NOT NULL) WHERE fall IS NOT NULL GROUP BY 1""")  # fmt: skip
_case("scan_lines", lambda p: flightlines.scan_lines(p).groupBy("source_file").agg(F.max("scan_line").alias("lines")), """SELECT source_file, CAST(sum(c) AS BIGINT) AS lines FROM
    (SELECT source_file, CASE WHEN lag(scan_direction_flag) OVER (PARTITION BY source_file ORDER BY point_index) <> scan_direction_flag THEN 1 ELSE 0 END AS c FROM pts) GROUP BY 1""")  # fmt: skip

# --- values by a table of pairs
_PAIRS = [(1, 101), (2, 7), (3, 3), (500, 12), (900, 13)]
for _name, _c in (("map_user_data", "user_data"), ("map_point_source", "point_source_id"), ("map_intensity", "intensity")):
    QUERIES[_name] = lambda spark, sf, c=_c: map_values(lineitem_points(spark, sf), c, spark.createDataFrame(_PAIRS, "from int, to int")).select("source_file", "point_index", c)
    ORACLE_SQL[_name] = points_sql(f"SELECT {_K}, CASE {_c} " + " ".join(f"WHEN {a} THEN {b}" for a, b in _PAIRS) + f" ELSE {_c} END AS {_c} FROM pts")

# --- two inputs
_case("merge_scales", lambda p: matching.merge((p.where("zi % 2 = 0"), ScaleOffset()), (p.where("zi % 2 = 1"), ScaleOffset((0.1, 0.1, 0.1), (5.0, 0.0, 0.0)))).select("xi", "yi", "zi"),
      "SELECT xi, yi, zi FROM pts WHERE zi % 2 = 0 UNION ALL SELECT xi * 10 + 500, yi * 10, zi * 10 FROM pts WHERE zi % 2 = 1")
_case("diff_points", lambda p: matching.diff(p, p.withColumn("zi", F.when(F.col("zi") % 10 == 0, F.col("zi") + 1).otherwise(F.col("zi"))).where("zi % 7 <> 0"), ["xi", "yi", "zi"]),
      f"""WITH b AS (SELECT {_K}, zi, CASE WHEN zi % 10 = 0 THEN zi + 1 ELSE zi END AS z2 FROM pts)
      SELECT {_K}, CASE WHEN z2 % 7 = 0 THEN 'only left' ELSE 'zi' END AS changed FROM b WHERE z2 % 7 = 0 OR z2 <> zi""")  # fmt: skip
_case("diff_rows", lambda p: matching.rows_that_differ(p.select("xi", "zi"), p.where("zi % 50 <> 0").select("xi", "zi")), "SELECT xi, zi, 'left' AS side FROM pts WHERE zi % 50 = 0")
_case("copy_attributes", lambda p: matching.copy_attributes(p, p.where("classification = 2"), ["user_data", "intensity"]).select("source_file", "point_index", "user_data", "intensity"),
      f"""WITH s AS (SELECT gps_time, return_number, min(struct_pack(u := user_data, i := intensity)) AS v FROM pts WHERE classification = 2 AND gps_time IS NOT NULL GROUP BY 1, 2)
      SELECT {_K}, coalesce(v.u, user_data) AS user_data, coalesce(v.i, intensity) AS intensity FROM pts LEFT JOIN s USING (gps_time, return_number)""")  # fmt: skip
_case("copy_attributes_zero", lambda p: matching.copy_attributes(p, p.where("classification = 2"), ["user_data"], zero=True).select("source_file", "point_index", "user_data"),
      f"""WITH s AS (SELECT gps_time, return_number, min(user_data) AS v FROM pts WHERE classification = 2 AND gps_time IS NOT NULL GROUP BY 1, 2)
      SELECT {_K}, coalesce(v, 0) AS user_data FROM pts LEFT JOIN s USING (gps_time, return_number)""")  # fmt: skip
_marks = "(SELECT CAST(s_suppkey AS VARCHAR) AS name, CAST(s_suppkey * 10 + 5 AS DOUBLE) AS x, CAST(s_suppkey * 10 + 2 AS DOUBLE) AS y, CAST(100 AS DOUBLE) AS z FROM supplier)"
QUERIES["control_points"] = lambda spark, sf: matching.control(
    lineitem_points(spark, sf),
    spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("cast(s_suppkey as string) name", "cast(s_suppkey * 10 + 5 as double) x", "cast(s_suppkey * 10 + 2 as double) y", "100D z"), 50.0,
)
ORACLE_SQL["control_points"] = points_sql(f"""SELECT name, avg({Z}) - z AS dz FROM {_marks} AS m JOIN pts ON abs({CELL[0]} - floor(x / 50.0)) <= 1 AND abs({CELL[1]} - floor(y / 50.0)) <= 1 GROUP BY name, z""")
_case("track_height", lambda p: matching.track(p, p.where("classification = 2 AND gps_time IS NOT NULL").groupBy("source_file", F.col("gps_time")).agg(F.min(xyz("z")).alias("z"))).select("source_file", "point_index", "track_z"),
      f"""WITH t AS (SELECT source_file, gps_time AS t, min({Z}) AS z FROM pts WHERE classification = 2 AND gps_time IS NOT NULL GROUP BY 1, 2),
      a AS (SELECT p.source_file, p.point_index, p.gps_time, t0.t AS t0, t0.z AS z0 FROM (SELECT * FROM pts WHERE gps_time IS NOT NULL) p ASOF LEFT JOIN t t0 ON p.source_file = t0.source_file AND p.gps_time >= t0.t),
      b AS (SELECT a.*, t1.t AS t1, t1.z AS z1 FROM a ASOF LEFT JOIN t t1 ON a.source_file = t1.source_file AND a.gps_time <= t1.t)
      SELECT source_file, point_index, CASE WHEN t1 > t0 THEN z0 + (z1 - z0) * (gps_time - t0) / (t1 - t0) ELSE coalesce(z0, z1) END AS track_z FROM b
      UNION ALL SELECT source_file, point_index, NULL FROM pts WHERE gps_time IS NULL""")  # fmt: skip
_case("colour_from_raster", lambda p: matching.colour(p, raster.cells(p.where("classification = 2"), 50.0).groupBy("col", "row").agg(*[F.max(c).alias(c) for c in ("red", "green", "blue")]), 50.0).select("source_file", "point_index", "red", "green", "blue"),
      f"""WITH r AS (SELECT {AS_CELL}, max(red) AS r, max(green) AS g, max(blue) AS b FROM pts WHERE classification = 2 GROUP BY 1, 2), p AS (SELECT *, {AS_CELL} FROM pts)
      SELECT {_K}, coalesce(r, red) AS red, coalesce(g, green) AS green, coalesce(b, blue) AS blue FROM p LEFT JOIN r USING (col, row)""")  # fmt: skip


def _edits(p: DataFrame) -> DataFrame:
    layers = F.explode(F.sequence(F.lit(1), F.lit(3)))
    e = p.where("zi % 5 = 0").select("source_file", "point_index", "zi", layers.alias("layer")).where("zi % (layer + 1) = 0")
    return e.select("source_file", "point_index", "layer", (F.col("layer") + 10).alias("classification"))


_case("layers_first_two", lambda p: matching.apply_layers(p, _edits(p), 2).select("source_file", "point_index", "classification"),
      f"SELECT {_K}, CASE WHEN zi % 5 = 0 AND zi % 3 = 0 THEN 12 WHEN zi % 5 = 0 AND zi % 2 = 0 THEN 11 ELSE classification END AS classification FROM pts")

# --- tiles, polygons, index
_case("tile_assign", lambda p: spatial.tiles(p, 100.0).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n")),
      f"SELECT CAST(floor({X} / 100.0) AS BIGINT) AS tile_col, CAST(floor({Y} / 100.0) AS BIGINT) AS tile_row, count(*) AS n FROM pts GROUP BY 1, 2")
_case("tile_buffered", lambda p: spatial.tiles(p, 100.0, 10.0).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_buffer").alias("buffered")),
      f"""WITH t AS (SELECT {X} AS x, {Y} AS y FROM pts), e AS (SELECT *, unnest(range(CAST(floor((x - 10) / 100.0) AS BIGINT), CAST(floor((x + 10) / 100.0) AS BIGINT) + 1)) AS tile_col FROM t),
      f AS (SELECT *, unnest(range(CAST(floor((y - 10) / 100.0) AS BIGINT), CAST(floor((y + 10) / 100.0) AS BIGINT) + 1)) AS tile_row FROM e)
      SELECT tile_col, tile_row, count(*) AS n, count(*) FILTER (tile_col <> floor(x / 100.0) OR tile_row <> floor(y / 100.0)) AS buffered FROM f GROUP BY 1, 2""")  # fmt: skip
QUERIES["tile_refined"] = lambda spark, sf: spatial.refine_tiles(lineitem_points(spark, sf), 256.0, 200).groupBy("tile_level", "tile_index").agg(F.count(F.lit(1)).alias("n"))
_morton = " + ".join(f"((CAST(floor({v} / 4) AS BIGINT) >> {k} & 1) << {2 * k + odd})" for odd, v in enumerate((X, Y)) for k in range(24))
ORACLE_SQL["tile_refined"] = points_sql(f"""WITH c AS (SELECT {_morton} AS m, count(*) AS n FROM pts GROUP BY 1), l AS (SELECT unnest(range(7)) AS level),
    e AS (SELECT m, n, level, m >> (2 * (6 - level)) AS i, sum(n) OVER (PARTITION BY level, m >> (2 * (6 - level))) AS t FROM c, l),
    f AS (SELECT m, any_value(n) AS n, min(level) AS level FROM e WHERE t <= 200 OR level = 6 GROUP BY m)
    SELECT CAST(level AS INT) AS tile_level, m >> (2 * (6 - level)) AS tile_index, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2""")
POLYGON = [[(100.0, 0.0), (900.0, 100.0), (700.0, 800.0), (150.0, 500.0)], [(300.0, 150.0), (500.0, 150.0), (400.0, 350.0)]]


def _crossings() -> str:
    out = []
    for ring in POLYGON:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y0 != y1:
                out.append(f"CASE WHEN {Y} >= {min(y0, y1)} AND {Y} < {max(y0, y1)} AND {X} < {x0} + ({Y} - {y0}) * CAST({(x1 - x0) / (y1 - y0)!r} AS DOUBLE) THEN 1 ELSE 0 END")
    return f"({' + '.join(out)}) % 2"


_case("clip_inside", lambda p: spatial.clip(p, POLYGON).select("xi", "yi", "zi"), f"SELECT xi, yi, zi FROM pts WHERE {_crossings()} = 1")
_case("clip_outside", lambda p: spatial.clip(p, POLYGON, False).select("xi", "yi", "zi"), f"SELECT xi, yi, zi FROM pts WHERE {_crossings()} = 0")
_case("clip_classify", lambda p: spatial.classify_inside(p, POLYGON, 6).select("xi", "yi", "classification"), f"SELECT xi, yi, CASE WHEN {_crossings()} = 1 THEN 6 ELSE classification END AS classification FROM pts")


def _edges(spark: SparkSession) -> DataFrame:
    rows = [("p", *a, *b) for ring in POLYGON for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return spark.createDataFrame(rows, "name string, x0 double, y0 double, x1 double, y1 double")


QUERIES["clip_many"] = lambda spark, sf: spatial.clip_many(lineitem_points(spark, sf).select("source_file", "point_index", "xi", "yi"), _edges(spark), 50.0)
ORACLE_SQL["clip_many"] = points_sql(f"SELECT {_K}, xi, yi, 'p' AS name FROM pts WHERE {_crossings()} = 1")
_bits = lambda v, odd: " + ".join(f"((CAST(floor({v} / 64.0) AS BIGINT) >> {b}) & 1) * {1 << (2 * b + odd)}" for b in range(6))
_case("quadtree_cells", lambda p: spatial.quadtree_cell(p, 0.0, 0.0, 64.0, 6).groupBy("cell_index").agg(F.count(F.lit(1)).alias("n")),
      f"SELECT {_bits(X, 0)} + {_bits(Y, 1)} + 1365 AS cell_index, count(*) AS n FROM pts GROUP BY 1")
_w = "PARTITION BY source_file, cell_index ORDER BY point_index"
_case("index_intervals", lambda p: spatial.index_intervals(spatial.quadtree_cell(p, 0.0, 0.0, 64.0, 6), 5), f"""WITH q AS (SELECT *, {_bits(X, 0)} + {_bits(Y, 1)} + 1365 AS cell_index FROM pts),
    j AS (SELECT *, CASE WHEN point_index - lag(point_index) OVER ({_w}) > 6 THEN 1 ELSE 0 END AS b FROM q), r AS (SELECT *, sum(b) OVER ({_w} ROWS UNBOUNDED PRECEDING) AS r FROM j)
    SELECT source_file, cell_index, min(point_index) AS first, max(point_index) AS last, count(*) AS "full" FROM r GROUP BY source_file, cell_index, r""")  # fmt: skip
QUERIES["index_merged_intervals"] = lambda spark, sf: spatial.merged_intervals(spatial.index_intervals(spatial.quadtree_cell(lineitem_points(spark, sf), 0.0, 0.0, 64.0, 6), 5).where("cell_index % 3 = 0"))
_case("sort_spatial", lambda p: spatial.sort_spatially(p, 64.0).select("source_file", "point_index", "xi"), f"SELECT {_K}, xi FROM pts")
_case("sort_gps_time", lambda p: spatial.sort_by(p, "gps_time").select("source_file", "point_index", "gps_time"), f"SELECT {_K}, gps_time FROM pts")
_case("multipoint_records", lambda p: spatial.multipoints(p, 256).select("source_file", "record", F.size("coordinates").alias("n")), "SELECT source_file, point_index // 256 AS record, CAST(count(*) AS INT) AS n FROM pts GROUP BY 1, 2")
_case("planes", lambda p: spatial.planes(p, 200.0).select("col", "row", "n", F.round(F.col("e1") + F.col("e2") + F.col("e3"), 3).alias("trace")),
      f"""SELECT CAST(floor({X} / 200.0) AS BIGINT) AS col, CAST(floor({Y} / 200.0) AS BIGINT) AS row, count(*) AS n, round(var_pop({X}) + var_pop({Y}) + var_pop({Z}), 3) AS trace FROM pts GROUP BY 1, 2 HAVING count(*) >= 3""")
