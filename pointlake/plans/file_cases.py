"""Queries of the LAS source: mixed scalings, extended formats, extra attributes, headers, bounds and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators import workflows
from pointlake.operators.filters import keep_circle, xyz
from pointlake.plans.point_cases import points_sql
from pointlake.plans.surface_cases import scratch
from pointlake.schema import lineitem_points
from pointlake.sources import binary, las, ptx, records

QUERIES, ORACLE_SQL = {}, {}


def _written(spark: SparkSession, points: DataFrame, folder: str | None = None, **options: str) -> str:
    las.register(spark)
    folder = folder or scratch(spark)[0]
    points.write.format("las").options(**options).mode("append").save(folder)
    return folder


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of two kinds of files: ground in millimetres from an offset, all else in the library's scale from another."""
    points = lineitem_points(spark, sf)
    fine = {"inScale": "0.001,0.001,0.001", "inOffset": "500,200,10", "scale": "0.001,0.001,0.001", "offset": "500,200,10"}
    folder = _written(spark, points.where("classification = 2"), **fine)
    _written(spark, points.where("classification <> 2"), folder, offset="1000,2000,-30")
    return spark.read.format("las").load(folder)


_MIXED_SQL = """
mixed AS (
  SELECT CAST(CASE WHEN classification = 2 THEN floor((xi * CAST(0.001 AS DOUBLE) + 500) / CAST(0.01 AS DOUBLE) + 0.5) ELSE xi END AS INT) AS xi,
    CAST(CASE WHEN classification = 2 THEN floor((yi * CAST(0.001 AS DOUBLE) + 200) / CAST(0.01 AS DOUBLE) + 0.5) ELSE yi END AS INT) AS yi,
    CAST(CASE WHEN classification = 2 THEN floor((zi * CAST(0.001 AS DOUBLE) + 10) / CAST(0.01 AS DOUBLE) + 0.5) ELSE zi END AS INT) AS zi, classification
  FROM pts)"""


def _mixed_sql(select: str) -> str:
    return points_sql(f"SELECT * FROM (WITH {_MIXED_SQL} {select})")


QUERIES["las_mixed_scales"] = lambda spark, sf: _mixed(spark, sf).select("xi", "yi", "zi", "classification")
ORACLE_SQL["las_mixed_scales"] = _mixed_sql("SELECT xi, yi, zi, classification FROM mixed")
QUERIES["las_mixed_circle"] = lambda spark, sf: _mixed(spark, sf).where(keep_circle(520.0, 230.0, 60.0)).select("xi", "yi", "classification")
ORACLE_SQL["las_mixed_circle"] = _mixed_sql("""SELECT xi, yi, classification FROM mixed WHERE xi * 0.01 >= 460 AND xi * 0.01 < 580 AND yi * 0.01 >= 170 AND yi * 0.01 < 290
    AND (CAST(xi AS DOUBLE) * CAST(0.01 AS DOUBLE) - 520) * (CAST(xi AS DOUBLE) * CAST(0.01 AS DOUBLE) - 520) + (CAST(yi AS DOUBLE) * CAST(0.01 AS DOUBLE) - 230) * (CAST(yi AS DOUBLE) * CAST(0.01 AS DOUBLE) - 230) < 3600""")
QUERIES["las_mixed_raster"] = lambda spark, sf: _mixed(spark, sf).groupBy(F.floor(xyz("x") / 25.0).alias("col"), F.floor(xyz("y") / 25.0).alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("zi").alias("low"), F.max("zi").alias("high"))
ORACLE_SQL["las_mixed_raster"] = _mixed_sql("SELECT CAST(floor(xi * CAST(0.01 AS DOUBLE) / 25) AS BIGINT) AS col, CAST(floor(yi * CAST(0.01 AS DOUBLE) / 25) AS BIGINT) AS row, count(*) AS n, min(zi) AS low, max(zi) AS high FROM mixed GROUP BY 1, 2")

_EXTENDED = ("xi", "yi", "zi", "classification", "ext_classification", "ext_return_number", "ext_number_of_returns", "overlap_flag", "scanner_channel", "withheld_flag", "nir", "blue")
_EXTENDED_SQL = points_sql("""SELECT xi, yi, zi, CASE WHEN ext_classification <= 31 THEN ext_classification ELSE 0 END AS classification, ext_classification, ext_return_number, ext_number_of_returns,
    overlap_flag, scanner_channel, withheld_flag, nir, blue, scan_angle_rank, round(attr_0 * 100) AS height, round(attr_1 * 100) AS range FROM pts""")


def _extended(spark: SparkSession, sf: str, **options: str) -> DataFrame:
    folder = _written(spark, lineitem_points(spark, sf), pointFormat="8", extra="attr_0=height,attr_1=range", **options)
    read = spark.read.format("las").option("columns", ",".join([*_EXTENDED, "scan_angle", "attr_0", "attr_1"])).load(folder)
    return read.select(*_EXTENDED, F.round("scan_angle").cast("int").alias("scan_angle_rank"), F.round(F.col("attr_0") * 100).alias("height"), F.round(F.col("attr_1") * 100).alias("range"))


QUERIES["las_extended"] = _extended
QUERIES["las_compatible"] = lambda spark, sf: _extended(spark, sf, compatible="true")
ORACLE_SQL |= {"las_extended": _EXTENDED_SQL, "las_compatible": _EXTENDED_SQL}


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    folder = _written(spark, lineitem_points(spark, sf), recordsPerFile="5000")
    headers = spark.read.format("las_headers").load(folder)
    box = [f(f"{m}_{a}").alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    first = [F.sum(F.col("by_return")[k]).alias(f"returns_{k + 1}") for k in range(5)]
    return headers.agg(F.sum("points").alias("points"), F.max("points").alias("most"), *box, *first)


QUERIES["las_headers"] = _headers
ORACLE_SQL["las_headers"] = points_sql(f"""SELECT count(*) AS points, least(count(*), 5000) AS most,
    {", ".join(f"{m}({a}i * CAST(0.01 AS DOUBLE)) AS {m}_{a}" for m in ("min", "max") for a in "xyz")},
    {", ".join(f"count(*) FILTER (return_number = {k}) AS returns_{k}" for k in range(1, 6))} FROM pts""")


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted along a curve, with an index beside each file; the comparisons are pushed down to the files and their cells."""
    from pointlake.operators.spatial import sort_spatially

    folder = _written(spark, sort_spatially(lineitem_points(spark, sf), 50.0), recordsPerFile="20000")
    las.write_index(spark, folder, 100.0)
    return spark.read.format("las").load(folder).where("x >= 300 AND x < 700 AND y > 100 AND y <= 500").select("xi", "yi", "zi")


QUERIES["las_bounded"] = _bounded
ORACLE_SQL["las_bounded"] = points_sql("SELECT xi, yi, zi FROM pts WHERE xi >= 30000 AND xi < 70000 AND yi > 10000 AND yi <= 50000")


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    binary.register(spark)
    folder = scratch(spark)[0]
    lineitem_points(spark, sf).select(*[xyz(a).alias(a) for a in "xyz"]).write.format("shapefile").mode("append").save(folder)
    return spark.read.format("shapefile").load(folder).select(*[F.round(F.col(a) * 100).cast("int").alias(f"{a}i") for a in "xyz"])


QUERIES["shapefile_write_read"] = _shapes
ORACLE_SQL["shapefile_write_read"] = points_sql("SELECT xi, yi, zi FROM pts")


def _bil(spark: SparkSession, sf: str) -> DataFrame:
    """The count of points of each cell of 25, as a raster in files and read again by its places."""
    binary.register(spark)
    folder = scratch(spark)[0]
    counts = lineitem_points(spark, sf).groupBy(F.floor(xyz("x") / 25.0).alias("col"), F.floor(xyz("y") / 25.0).alias("row")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    binary.write_bil(counts, folder, 25.0).agg(F.sum("cells")).collect()
    return spark.read.format("bil").load(folder).select(F.floor(F.col("x") / 25).alias("col"), F.floor(F.col("y") / 25).alias("row"), "value")


QUERIES["bil_write_read"] = _bil
ORACLE_SQL["bil_write_read"] = points_sql("SELECT CAST(floor(xi * CAST(0.01 AS DOUBLE) / 25) AS BIGINT) AS col, CAST(floor(yi * CAST(0.01 AS DOUBLE) / 25) AS BIGINT) AS row, CAST(count(*) AS DOUBLE) AS value FROM pts GROUP BY 1, 2")


def _through(spark: SparkSession, points: DataFrame, kind: str, **options: str) -> DataFrame:
    """Points as read from the files that they were written to."""
    records.register(spark)
    folder = scratch(spark)[0]
    points.write.format(kind).options(**options).mode("append").save(folder)
    return spark.read.format(kind).load(folder)


def _terrasolid(spark: SparkSession, sf: str, **options: str) -> DataFrame:
    points = lineitem_points(spark, sf).withColumn("gps_time", F.pmod(F.col("gps_time"), F.lit(604800.0)))
    return _through(spark, points, "terrasolid", **options).select(
        "xi", "yi", "zi", "intensity", "return_number", "number_of_returns", "classification", F.col("point_source_id").alias("line"),
        F.round(F.col("gps_time") * 10).cast("long").alias("tenths"), "red", "green", "blue",
    )


def _terrasolid_sql(line: str) -> str:
    return points_sql(f"""SELECT xi, yi, zi, intensity, CASE WHEN number_of_returns <= 1 OR return_number = 1 THEN 1 ELSE 2 END AS return_number,
        CASE WHEN number_of_returns <= 1 THEN 1 WHEN return_number = 1 OR return_number >= number_of_returns THEN 2 ELSE 3 END AS number_of_returns, classification, {line} AS line,
        CAST(coalesce((CAST(gps_time AS BIGINT) % 604800 + 604800) % 604800, 0) * 10 AS BIGINT) AS tenths, red // 256 * 256 AS red, green // 256 * 256 AS green, blue // 256 * 256 AS blue FROM pts""")


QUERIES["terrasolid_write_read"] = _terrasolid
ORACLE_SQL["terrasolid_write_read"] = _terrasolid_sql("point_source_id")
QUERIES["terrasolid_narrow"] = lambda spark, sf: _terrasolid(spark, sf, layout="ts8")
ORACLE_SQL["terrasolid_narrow"] = _terrasolid_sql("point_source_id % 256")


def _qfit(spark: SparkSession, sf: str) -> DataFrame:
    """Raw coordinates as longitudes and latitudes by remainders, seconds of a day as times, waves as attitude."""
    degrees = {"x": (F.col("xi") % 360_000 - 180_000) / 1000.0, "y": (F.col("yi") % 180_000 - 90_000) / 1000.0, "z": F.col("zi") / 1000.0, "gps_time": F.pmod(F.col("gps_time"), F.lit(86_400.0))}
    points = lineitem_points(spark, sf).withColumns(degrees | {"pitch": F.col("wave_xt"), "roll": -F.col("wave_yt"), "pulse_width": F.col("user_data")})
    kept = [F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("x", "y", "z", "gps_time", "pitch", "roll")]
    return _through(spark, points, "qfit").select(*kept, "intensity", "pulse_width", "scan_angle_rank")


QUERIES["qfit_write_read"] = _qfit
ORACLE_SQL["qfit_write_read"] = points_sql("""SELECT CAST(xi % 360000 - 180000 AS BIGINT) AS x, CAST(yi % 180000 - 90000 AS BIGINT) AS y, CAST(zi AS BIGINT) AS z,
    CAST(coalesce((CAST(gps_time AS BIGINT) % 86400 + 86400) % 86400, 0) * 1000 AS BIGINT) AS gps_time, CAST(round(wave_xt * 1000) AS BIGINT) AS pitch, CAST(round(-wave_yt * 1000) AS BIGINT) AS roll,
    intensity, user_data AS pulse_width, CAST(greatest(scan_angle_rank - 180, -128) AS INT) AS scan_angle_rank FROM pts""")
QUERIES["ply_write_read"] = lambda spark, sf: _through(spark, lineitem_points(spark, sf), "ply").select("xi", "yi", "zi", "intensity", "red", "green", "blue")
ORACLE_SQL["ply_write_read"] = points_sql(f"SELECT xi, yi, zi, intensity, {', '.join(f'CASE WHEN {c} > 255 THEN {c} // 256 ELSE {c} END AS {c}' for c in ('red', 'green', 'blue'))} FROM pts")


def _vrml(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of points of the files."""
    records.register(spark)
    folder = scratch(spark)[0]
    lineitem_points(spark, sf).write.format("vrml").option("colour", "false").mode("append").save(folder)
    words = F.split("value", " ")
    return spark.read.text(folder).where(F.col("value").rlike("^[-0-9.]+ [-0-9.]+ [-0-9.]+$")).select(*[F.round(words[k].cast("double") * 100).cast("int").alias(f"{a}i") for k, a in enumerate("xyz")])


QUERIES["vrml_write"] = _vrml
ORACLE_SQL["vrml_write"] = points_sql("SELECT xi, yi, zi FROM pts")


def _dtm(spark: SparkSession, sf: str) -> DataFrame:
    """The highest point of each cell of 25, as a raster in files and read again by its places."""
    records.register(spark)
    folder = scratch(spark)[0]
    highest = lineitem_points(spark, sf).groupBy(F.floor(xyz("x") / 25.0).alias("col"), F.floor(xyz("y") / 25.0).alias("row")).agg(F.max("zi").cast("double").alias("value"))
    records.write_dtm(highest, folder, 25.0).agg(F.sum("cells")).collect()
    return spark.read.format("dtm").load(folder).select(F.floor(F.col("x") / 25).alias("col"), F.floor(F.col("y") / 25).alias("row"), "value")


QUERIES["dtm_write_read"] = _dtm
ORACLE_SQL["dtm_write_read"] = points_sql("SELECT CAST(floor(xi * CAST(0.01 AS DOUBLE) / 25) AS BIGINT) AS col, CAST(floor(yi * CAST(0.01 AS DOUBLE) / 25) AS BIGINT) AS row, CAST(max(zi) AS DOUBLE) AS value FROM pts GROUP BY 1, 2")


def _waves(spark: SparkSession, sf: str) -> DataFrame:
    """Written with packets of 8 or 12 samples made from each point's numbers, those of class 5 without; read by the packets' offsets."""
    las.register(spark)
    n = F.when(F.col("point_index") % 2 == 0, 8).otherwise(12)
    samples = F.when(F.col("classification") != 5, F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.col("xi") + F.col("zi") * k) % 65536))
    points = lineitem_points(spark, sf).withColumns({"samples": samples, "wave_location": F.lit(500.0), "wave_xt": F.lit(0.0), "wave_yt": F.lit(0.0), "wave_zt": F.lit(0.125)})
    folder = _written(spark, points, pointFormat="4", spacing="2000")
    waves = spark.read.format("las_waveforms").load(folder)
    return waves.select(
        F.round(F.col("x") * 100).cast("long").alias("xi"), F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"),
        F.col("samples")[1].cast("long").alias("second"), F.round(F.col("z") * 100 - 6250).cast("long").alias("zi"), F.col("step_z").cast("long").alias("step_z"),
    )


QUERIES["las_waveforms"] = _waves
ORACLE_SQL["las_waveforms"] = points_sql("""WITH w AS (SELECT CAST(xi AS BIGINT) AS xi, CAST(zi AS BIGINT) AS zi, CASE WHEN point_index % 2 = 0 THEN 8 ELSE 12 END AS n FROM pts WHERE classification <> 5)
    SELECT xi, zi, CAST(n AS INT) AS n, CAST(list_sum(list_transform(range(n), lambda k: (xi + zi * k) % 65536)) AS BIGINT) AS total, (xi + zi) % 65536 AS second, CAST(-250 AS BIGINT) AS step_z FROM w""")


def _optimized(spark: SparkSession, sf: str) -> DataFrame:
    """Raw coordinates in tenths, far from the origin in x: steps of a tenth and an offset; what is read is what was written."""
    folder = scratch(spark)[0]
    points = lineitem_points(spark, sf).withColumns({"xi": F.col("xi") * 10 + 300_000_000, "yi": F.col("yi") * 10})
    workflows.write_optimized(points, folder, 64.0)
    head = spark.read.format("las_headers").load(folder).select(F.col("source_file").alias("__f"), *[F.round(F.col("scale")[k], 6).alias(f"scale_{a}") for k, a in enumerate("xyz")], *[F.col("offset")[k].alias(f"offset_{a}") for k, a in enumerate("xyz")])
    read = spark.read.format("las").option("columns", "source_file,xi,yi,zi,user_data").load(folder)
    return read.join(head, F.col("source_file") == F.col("__f")).drop("source_file", "__f")


QUERIES["las_optimized"] = _optimized
ORACLE_SQL["las_optimized"] = points_sql("""WITH p AS (SELECT xi * 10 + 300000000 AS xi, yi * 10 AS yi, zi FROM pts),
    m AS (SELECT bool_and(xi % 100 = 0) AS x2, bool_and(yi % 100 = 0) AS y2, (min(xi) + max(xi)) * CAST(0.01 AS DOUBLE) AS sx, (min(yi) + max(yi)) * CAST(0.01 AS DOUBLE) AS sy, (min(zi) + max(zi)) * CAST(0.01 AS DOUBLE) AS sz, bool_and(zi % 10 = 0) AS z1 FROM p),
    s AS (SELECT CASE WHEN x2 THEN 1.0 ELSE 0.1 END AS tx, CASE WHEN y2 THEN 1.0 ELSE 0.1 END AS ty, CASE WHEN z1 THEN 0.1 ELSE 0.01 END AS tz, sx, sy, sz FROM m)
    SELECT CAST(xi AS INT) AS xi, CAST(yi AS INT) AS yi, zi, 0 AS user_data, CAST(tx AS DOUBLE) AS scale_x, CAST(ty AS DOUBLE) AS scale_y, CAST(tz AS DOUBLE) AS scale_z,
        CAST(trunc(sx / CAST(tx AS DOUBLE) / 20000000) * 10000000 * tx AS DOUBLE) AS offset_x, CAST(trunc(sy / CAST(ty AS DOUBLE) / 20000000) * 10000000 * ty AS DOUBLE) AS offset_y,
        CAST(trunc(sz / CAST(tz AS DOUBLE) / 20000000) * 10000000 * tz AS DOUBLE) AS offset_z FROM p, s""")


def _attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of one byte in hundredths, and of eight bytes in halves from 100 with a no-data value."""
    folder = _written(spark, lineitem_points(spark, sf), pointFormat="1", extra="wave_yt=discount:2:0.01,gps_time=time:8:0.5:100:-1")
    read = spark.read.format("las").option("columns", "xi,yi,attr_0,attr_1").load(folder)
    return read.select("xi", "yi", F.round(F.col("attr_0") * 100).cast("int").alias("hundredths"), F.col("attr_1").alias("time"))


QUERIES["las_added_attributes"] = _attributes
ORACLE_SQL["las_added_attributes"] = points_sql("SELECT xi, yi, CAST(round(wave_yt * 100) AS INT) AS hundredths, gps_time AS time FROM pts")


def _auto_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets from the box of the points, far from the origin in x: what is read is what was written."""
    points = lineitem_points(spark, sf).withColumn("xi", F.col("xi") + 300_000_000)
    fit = workflows.fitting_scaling(points)
    folder = _written(spark, points, scale=",".join(map(repr, fit.scale)), offset=",".join(map(repr, fit.offset)))
    return spark.read.format("las").options(columns="xi,yi,zi", scaling="true").load(folder).select("xi", "yi", "zi", "offset_x", "offset_y", "offset_z")


QUERIES["las_auto_offset"] = _auto_offset
ORACLE_SQL["las_auto_offset"] = points_sql("""WITH p AS (SELECT CAST(xi + 300000000 AS INT) AS xi, yi, zi FROM pts),
    m AS (SELECT trunc((min(xi) + max(xi)) / 20000000) * 100000 AS x, trunc((min(yi) + max(yi)) / 20000000) * 100000 AS y, trunc((min(zi) + max(zi)) / 20000000) * 100000 AS z FROM p)
    SELECT xi, yi, zi, CAST(x AS DOUBLE) AS offset_x, CAST(y AS DOUBLE) AS offset_y, CAST(z AS DOUBLE) AS offset_z FROM p, m""")


def _ptx(spark: SparkSession, sf: str) -> DataFrame:
    """Points as one scan with a turned and shifted scanner, read by ranges of the file's bytes and moved by its matrix."""
    ptx.register(spark)
    folder = scratch(spark)[0]
    points = lineitem_points(spark, sf).select(*[xyz(a).alias(a) for a in "xyz"], (F.col("intensity") / 4095).alias("strength"))
    points.write.format("ptx").options(matrix="0,1,0,0,-1,0,0,0,0,0,1,0,1000,2000,-50,1").mode("append").save(folder)
    return ptx.read_ptx(spark, folder, moved=True, bytesPerPartition="200000").select("xi", "yi", "zi", "intensity")


QUERIES["ptx_write_read"] = _ptx
ORACLE_SQL["ptx_write_read"] = points_sql("SELECT CAST(100000 - yi AS INT) AS xi, CAST(200000 + xi AS INT) AS yi, CAST(zi - 5000 AS INT) AS zi, intensity FROM pts")
