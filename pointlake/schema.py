"""The canonical point table, its scaling, and the point view over the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScaleOffset:
    """Coordinates are integers: x = xi * scale + offset, by axis."""

    scale: tuple[float, float, float] = (0.01, 0.01, 0.01)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def real(self, axis: str) -> Column:
        k = "xyz".index(axis)
        value = F.col(f"{axis}i") * F.lit(self.scale[k])
        return value + F.lit(self.offset[k]) if self.offset[k] else value

    def raw(self, axis: str, value: Column) -> Column:
        """The nearest integer, halves away from the offset."""
        k = "xyz".index(axis)
        steps = (value - F.lit(self.offset[k])) / F.lit(self.scale[k])
        return F.when(value >= self.offset[k], F.floor(steps + 0.5)).otherwise(F.ceil(steps - 0.5)).cast("int")


DEFAULT_SCALE = ScaleOffset()

#: The fields of a point, with their Spark types.
POINT_COLUMNS = {
    "source_file": "string", "point_index": "bigint", "xi": "int", "yi": "int", "zi": "int", "intensity": "int",
    "return_number": "int", "number_of_returns": "int", "scan_direction_flag": "int", "edge_of_flight_line": "int",
    "classification": "int", "synthetic_flag": "int", "keypoint_flag": "int", "withheld_flag": "int",
    "overlap_flag": "int", "scan_angle_rank": "int", "user_data": "int", "point_source_id": "int",
    "scanner_channel": "int", "ext_classification": "int", "ext_return_number": "int", "ext_number_of_returns": "int",
    "gps_time": "double", "red": "int", "green": "int", "blue": "int", "nir": "int", "wave_index": "int",
    "wave_xt": "double", "wave_yt": "double", "wave_zt": "double", "attr_0": "double", "attr_1": "double",
}

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"

#: The point view over lineitem, in SQL that Spark and DuckDB read alike. A supplier is a file.
POINTS_SQL = f"""
SELECT CAST(l_suppkey AS VARCHAR(20)) AS source_file,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_KEYS}) - 1 AS BIGINT) AS point_index,
  CAST(l_partkey * 100 + l_linenumber * 13 AS INT) AS xi,
  CAST(l_suppkey * 1000 + floor(l_quantity) * 7 AS INT) AS yi,
  CAST(floor(l_extendedprice) AS INT) AS zi,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4096 AS INT) AS intensity,
  CAST((l_linenumber - 1) % 5 + 1 AS INT) AS return_number,
  CAST(greatest((l_linenumber - 1) % 5 + 1, l_orderkey % 5 + 1) AS INT) AS number_of_returns,
  CAST(l_orderkey % 2 AS INT) AS scan_direction_flag,
  CAST(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS edge_of_flight_line,
  CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 5 END AS classification,
  CAST(l_partkey % 2 AS INT) AS synthetic_flag,
  CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS keypoint_flag,
  CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS withheld_flag,
  CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS overlap_flag,
  CAST(l_orderkey % 61 - 30 AS INT) AS scan_angle_rank,
  CAST(floor(l_quantity) AS INT) AS user_data,
  CAST(l_suppkey % 65536 AS INT) AS point_source_id,
  CAST(l_partkey % 4 AS INT) AS scanner_channel,
  CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE CAST(40 + l_partkey % 3 AS INT) END AS ext_classification,
  CAST((l_linenumber - 1) % 5 + 1 AS INT) AS ext_return_number,
  CAST(greatest((l_linenumber - 1) % 5 + 1, l_orderkey % 5 + 1) AS INT) AS ext_number_of_returns,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(datediff_days * 86400 + l_linenumber AS DOUBLE) END AS gps_time,
  CAST((l_partkey * 7) % 65536 AS INT) AS red,
  CAST((l_suppkey * 101) % 65536 AS INT) AS green,
  CAST((l_orderkey * 13) % 65536 AS INT) AS blue,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS INT) AS nir,
  CAST(l_partkey % 3 AS INT) AS wave_index,
  l_quantity AS wave_xt, l_discount AS wave_yt, l_tax AS wave_zt,
  l_discount * 100 AS attr_0, l_tax * 100 AS attr_1
FROM (SELECT *, DAYS_EXPR AS datediff_days FROM lineitem) AS l
"""
SPARK_POINTS = POINTS_SQL.replace("DAYS_EXPR", "datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01')").replace("VARCHAR(20)", "STRING")
DUCKDB_POINTS = POINTS_SQL.replace("DAYS_EXPR", "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point view over lineitem: what a query doesn't use of it, Catalyst prunes."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(SPARK_POINTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)


def with_xyz(points: DataFrame, scaling: ScaleOffset = DEFAULT_SCALE) -> DataFrame:
    """Adds x, y and z as doubles."""
    return points.withColumns({a: scaling.real(a) for a in "xyz"})
