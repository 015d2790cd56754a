"""Raster files as points and back: ASCII grids, and points of PLY text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def read_asc(spark: SparkSession, path: str) -> DataFrame:
    """col, row, x, y and z of every filled cell of an ASCII grid; row 0 is the lowest.

    The six header lines are read alone; data lines are numbered from the top within Spark's
    own line offsets, so the file must not be split: read as whole text of one grid.
    """
    whole = spark.read.text(path, wholetext=True)
    head = {k: F.regexp_extract("value", rf"(?i){k}\s+(\S+)", 1).cast("double") for k in HEADER}
    lines = whole.select(*[v.alias(k) for k, v in head.items()], F.split("value", "\n").alias("lines"))
    rows = lines.select("*", F.posexplode(F.filter("lines", lambda s: F.trim(s).rlike("^[-+.0-9]") & (F.length(F.trim(s)) > 0))).alias("from_top", "line"))
    cells = rows.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "word")).withColumn("z", F.col("word").cast("double"))
    kept = cells.where(F.col("z") != F.col("nodata_value")).withColumn("row", (F.col("nrows") - 1 - F.col("from_top")).cast("int"))
    middle = {"x": F.col("xllcorner") + (F.col("col") + 0.5) * F.col("cellsize"), "y": F.col("yllcorner") + (F.col("row") + 0.5) * F.col("cellsize")}
    return kept.withColumns(middle).select("col", "row", "x", "y", "z")


def to_asc_lines(raster: DataFrame, first_col: int, cols: int, nodata: float = -9999.0) -> DataFrame:
    """row and its `line` of an ASCII grid, highest row first when ordered by row descending. A row is at most `cols` cells."""
    cells = raster.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    words = F.transform(F.sequence(F.lit(first_col), F.lit(first_col + cols - 1)), lambda c: F.coalesce(F.try_element_at("m", c.cast("long")), F.lit(nodata)).cast("string"))
    return cells.select("row", F.array_join(words, " ").alias("line"))


def read_ply_text(spark: SparkSession, path: str) -> DataFrame:
    """x, y and z of the vertices of a text PLY file."""
    words = F.split(F.trim("value"), r"\s+")
    number = F.trim("value").rlike(r"^[-+.0-9eE]+(\s+[-+.0-9eE]+){2,}$")
    faces = F.trim("value").rlike(r"^3 \d+ \d+ \d+$")
    return spark.read.text(path).where(number & ~faces).select(*[words[i].cast("double").alias(a) for i, a in enumerate("xyz")])
