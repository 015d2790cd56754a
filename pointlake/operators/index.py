"""A quadtree over points as plain columns: its setup, its cells and boxes, regions, intervals, and a written index.

A cell of level `levels` has the Morton code of its column and row, counted from the lower left.
Parquet's own statistics prune points that `spatial.sort_spatially` has dealt; this index serves
files that keep their order.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlake.functions.columns import morton
from pointlake.operators.filters import xyz


@dataclass(frozen=True)
class Quadtree:
    min_x: float
    min_y: float
    cell: float
    levels: int
    sub_level: int = 0  # of a tile within a larger tree: the tile's level and code there
    sub_code: int = 0

    @staticmethod
    def tiling(min_x: float, min_y: float, size: float, levels: int) -> Quadtree:
        """A square of the given side, halved `levels` times."""
        return Quadtree(min_x, min_y, size / 2**levels, levels)

    def tile(self, level: int, code: int, levels: int) -> Quadtree:
        """The tree of one cell of this one, halved `levels` times more; its cells' indexes are those of the larger tree."""
        col, row = (sum((code >> 2 * k + odd & 1) << k for k in range(level)) for odd in (0, 1))
        size = self.cell * 2 ** (self.levels - level)
        return Quadtree(self.min_x + col * size, self.min_y + row * size, size / 2**levels, levels, self.sub_level + level, (self.sub_code << 2 * level) + code)

    def cell_index(self, level: Column, code: Column) -> Column:
        """One number for cells of all levels: those of coarser levels come first."""
        deep = F.shiftleft(F.lit(self.sub_code).cast("long"), 0) * F.pow(F.lit(4.0), level).cast("long") + code
        return ((F.pow(F.lit(4.0), level + self.sub_level) - 1) / 3).cast("long") + deep

    @staticmethod
    def around(min_x: float, min_y: float, max_x: float, max_y: float, cell: float) -> Quadtree:
        """The box goes out to whole cells, one more at the upper end, and is filled up to a power of two, the larger half below."""
        first = floor(min_x / cell), floor(min_y / cell)
        count = floor(max_x / cell) + 1 - first[0], floor(max_y / cell) + 1 - first[1]
        levels = max(0, ceil(log2(max(count))))
        low = [f - ((1 << levels) - n + 1) // 2 for f, n in zip(first, count, strict=True)]
        return Quadtree(low[0] * cell, low[1] * cell, cell, levels)

    @staticmethod
    def of(points: DataFrame, cell: float) -> Quadtree:
        box = points.agg(*[f(xyz(a)) for f in (F.min, F.max) for a in "xy"]).first()
        return Quadtree.around(*box, cell) if box[0] is not None else Quadtree(0.0, 0.0, cell, 0)

    def code(self, x: Column, y: Column) -> Column:
        return morton(F.floor((x - self.min_x) / self.cell), F.floor((y - self.min_y) / self.cell), self.levels)

    def indexed(self, points: DataFrame) -> DataFrame:
        """Adds cell_code."""
        return points.withColumn("cell_code", self.code(xyz("x"), xyz("y")))

    def box(self, code: Column, level: int | None = None) -> dict[str, Column]:
        """cell_min_x, cell_min_y, cell_max_x and cell_max_y of a code of the given level (else the lowest one)."""
        level = self.levels if level is None else level
        size = self.cell * (1 << (self.levels - level))
        bit = lambda k: F.shiftright(code, k).bitwiseAND(F.lit(1).cast("long"))
        side = lambda odd: sum((F.shiftleft(bit(2 * k + odd), k) for k in range(level)), F.lit(0).cast("long"))
        low = {"x": self.min_x + side(0) * size, "y": self.min_y + side(1) * size}
        return {f"cell_min_{a}": v for a, v in low.items()} | {f"cell_max_{a}": v + size for a, v in low.items()}

    def rectangle(self, spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
        """cell_code of the cells that meet a rectangle, made by Spark from ranges of columns and rows."""
        most = (1 << self.levels) - 1
        a, b = (max(0, floor((v - m) / self.cell)) for v, m in ((min_x, self.min_x), (min_y, self.min_y)))
        c, d = (min(most, ceil((v - m) / self.cell) - 1) for v, m in ((max_x, self.min_x), (max_y, self.min_y)))
        rows = spark.range(b, d + 1).select(F.col("id").alias("row"))
        cells = rows.withColumn("col", F.explode(F.sequence(F.lit(a), F.lit(c)) if c >= a else F.array().cast("array<int>")))
        return cells.select(morton(F.col("col"), F.col("row"), self.levels).alias("cell_code"), "col", "row")

    def adapted(self, indexed: DataFrame, least: int) -> DataFrame:
        """level, code and n of cells, so that sparse ones are merged: four cells become one while all four are there and hold fewer than `least` points together.

        indexed: points with cell_code. A cell of a coarser level stands for all its quadrants, each
        of them occupied and itself merged, and so for 4**k occupied cells of the lowest level; that
        is one aggregate over all levels, without going up level by level.
        """
        return self.cells_by_level(indexed, least).groupBy("level", "code").agg(F.sum("n").alias("n"))

    def cells_by_level(self, indexed: DataFrame, least: int) -> DataFrame:
        """cell_code and n of the occupied cells of the lowest level, with the level and code of the cell that stands for each after merging."""
        base = indexed.where("cell_code IS NOT NULL").groupBy("cell_code").agg(F.count(F.lit(1)).alias("n"))
        up = lambda level: F.call_function("shiftright", F.col("cell_code"), ((F.lit(self.levels) - level) * 2).cast("int"))
        each = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.levels)))).withColumn("code", up(F.col("level")))
        whole = each.groupBy("level", "code").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("filled"))
        full = F.col("filled") == F.pow(F.lit(4.0), F.lit(self.levels) - F.col("level"))
        whole = whole.where((F.col("level") == self.levels) | (full & (F.col("all") < least))).select("level", "code")
        chosen = each.join(whole, ["level", "code"]).groupBy("cell_code", "n").agg(F.min("level").alias("level"))
        return chosen.withColumn("code", up(F.col("level")))

    def boxes(self, cells: DataFrame) -> DataFrame:
        """cells (level, code) of any levels with cell_min_x, cell_min_y, cell_max_x and cell_max_y."""
        size = F.pow(F.lit(2.0), F.lit(self.levels) - F.col("level")) * self.cell
        bit = lambda k: F.shiftright("code", k).bitwiseAND(F.lit(1).cast("long"))
        side = lambda odd: sum((F.shiftleft(bit(2 * k + odd), k) for k in range(self.levels)), F.lit(0).cast("long"))
        low = {"x": self.min_x + side(0) * size, "y": self.min_y + side(1) * size}
        return cells.withColumns({f"cell_min_{a}": v for a, v in low.items()} | {f"cell_max_{a}": v + size for a, v in low.items()})

    def meeting_rectangle(self, cells: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
        """Of cells of any levels those that meet a rectangle, its upper edges left out."""
        box = self.boxes(cells)
        return box.where((F.col("cell_min_x") < max_x) & (F.col("cell_max_x") > min_x) & (F.col("cell_min_y") < max_y) & (F.col("cell_max_y") > min_y)).select(*cells.columns)

    def meeting_circle(self, cells: DataFrame, x: float, y: float, radius: float) -> DataFrame:
        """Of cells of any levels those with a place inside a circle."""
        gap = lambda v, a: F.greatest(F.col(f"cell_min_{a}") - v, v - F.col(f"cell_max_{a}"), F.lit(0.0))
        dx, dy = gap(x, "x"), gap(y, "y")
        return self.boxes(cells).where(dx * dx + dy * dy < radius * radius).select(*cells.columns)

    def circle(self, spark: SparkSession, x: float, y: float, radius: float) -> DataFrame:
        """cell_code of the cells that meet a circle: those of its box whose nearest place is within the radius."""
        cells = self.rectangle(spark, x - radius, y - radius, x + radius, y + radius)
        gap = lambda v, low: F.greatest(low - v, v - low - self.cell, F.lit(0.0))
        dx, dy = gap(x, self.min_x + F.col("col") * self.cell), gap(y, self.min_y + F.col("row") * self.cell)
        return cells.where(dx * dx + dy * dy < radius * radius)


def coarsen(code: Column, levels: int = 1) -> Column:
    """The code of the cell so many levels up."""
    return F.shiftright(code, 2 * levels)


def points_of(indexed: DataFrame, cells: DataFrame) -> DataFrame:
    """The points whose cell is among the given ones."""
    return indexed.join(cells.select("cell_code"), "cell_code", "left_semi")


def limit_intervals(intervals: DataFrame, most: int) -> DataFrame:
    """Intervals of each file brought to at most `most` (and one for each cell): the smallest gaps are bridged, ties by cell and place.

    intervals: source_file, cell_index, first, last, full as `spatial.index_intervals` makes them.
    """
    in_cell = Window.partitionBy("source_file", "cell_index").orderBy("first")
    gaps = intervals.withColumn("__gap", F.col("first") - F.lag("last").over(in_cell))
    cells = intervals.groupBy("source_file").agg(F.count_distinct("cell_index").alias("__cells")).withColumnRenamed("source_file", "__file")
    widest = Window.partitionBy("source_file").orderBy(F.col("__gap").desc_nulls_last(), "cell_index", "first")
    ranked = gaps.withColumn("__rank", F.when(F.col("__gap").isNotNull(), F.row_number().over(widest)))
    met = ranked.join(cells, F.col("source_file") == F.col("__file"))
    kept = F.coalesce(F.col("__rank") <= F.lit(most) - F.col("__cells"), F.lit(False)).cast("int")
    runs = met.withColumn("__k", kept).withColumn("__run", F.sum("__k").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("source_file", "cell_index", "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("full").alias("full"))
    return joined.drop("__run")


def save_index(intervals: DataFrame, path: str) -> None:
    intervals.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
