"""Thinning, duplicates and noise."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pointlake.functions.columns import nearest
from pointlake.functions.components import components
from pointlake.functions.tables import written
from pointlake.operators.filters import xyz

ORDER = ("source_file", "point_index")


def thin_by_cell(points: DataFrame, step: float, which: str = "lowest", seed: int = 0) -> DataFrame:
    """One point of each cell int(v / step + 0.5): lowest, highest or random; of equals the first."""
    by = {"lowest": [F.col("zi")], "highest": [F.col("zi").desc()], "random": [F.xxhash64(*ORDER, F.lit(seed))]}[which]
    celled = points.withColumns({"cx": F.floor(xyz("x") / step + 0.5), "cy": F.floor(xyz("y") / step + 0.5)})
    window = Window.partitionBy("cx", "cy").orderBy(*by, *ORDER)
    return celled.withColumn("__k", F.row_number().over(window)).where("__k = 1").drop("__k")


def lowest_by_cell(points: DataFrame, step: float) -> DataFrame:
    """cx, cy, z and n: the lowest height and number of points of each cell, by partial sums only."""
    celled = points.select(F.floor(xyz("x") / step).alias("cx"), F.floor(xyz("y") / step).alias("cy"), "zi")
    return celled.groupBy("cx", "cy").agg(F.min("zi").alias("lowest_zi"), F.count(F.lit(1)).alias("n"))


def mark_duplicates(points: DataFrame, on: tuple[str, ...] = ("xi", "yi"), lowest_z: bool = False) -> DataFrame:
    """Adds is_duplicate: not the first (or, with lowest_z, the lowest) point at its place."""
    window = Window.partitionBy(*on).orderBy(*(["zi"] if lowest_z else []), *ORDER)
    return points.withColumn("is_duplicate", F.row_number().over(window) > 1)


def drop_duplicates(points: DataFrame, on: tuple[str, ...] = ("xi", "yi"), lowest_z: bool = False) -> DataFrame:
    return mark_duplicates(points, on, lowest_z).where(~F.col("is_duplicate")).drop("is_duplicate")


def removed_duplicates(points: DataFrame, on: tuple[str, ...] = ("xi", "yi"), lowest_z: bool = False) -> DataFrame:
    return mark_duplicates(points, on, lowest_z).where("is_duplicate").drop("is_duplicate")


def flag_duplicates(points: DataFrame, on: tuple[str, ...] = ("xi", "yi")) -> DataFrame:
    """Duplicates stay, with their withheld flag set."""
    marked = mark_duplicates(points, on)
    return marked.withColumn("withheld_flag", F.when(F.col("is_duplicate"), 1).otherwise(F.col("withheld_flag"))).drop("is_duplicate")


_BLOCK = 64  # cells of a block, each way


def _around(cells: DataFrame, names: tuple[str, str, str], look: Callable[[pa.Table, np.ndarray, list[np.ndarray]], dict[str, np.ndarray]], more: str) -> DataFrame:
    """cells with columns made from the up to 27 cells around each: look(cells of a block, its own ones, and for each of the 27 neighbours its row or -1).

    cells: distinct cells with whatever belongs to them. They are dealt to blocks once, those at a block's edge to
    its neighbours as well (about one in ten), and neighbours are found by their number within the block.
    """
    x, y, z = names
    edge = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / _BLOCK), F.floor((F.col(c) + 1) / _BLOCK))))
    dealt = cells.withColumn("__bx", edge(x)).withColumn("__by", edge(y))

    def run(table: pa.Table) -> pa.Table:
        at = {c: table.column(c).to_numpy().astype(np.int64) for c in (*names, "__bx", "__by")}
        cx, cy, cz = at[x] - at["__bx"] * _BLOCK, at[y] - at["__by"] * _BLOCK, at[z] - at[z].min() + 1
        tall = int(cz.max()) + 2
        key = ((cx + 1) * (_BLOCK + 2) + cy + 1) * tall + cz
        order = np.argsort(key, kind="stable")
        own = np.flatnonzero((cx >= 0) & (cx < _BLOCK) & (cy >= 0) & (cy < _BLOCK))
        near = []
        for dx, dy, dz in product((-1, 0, 1), repeat=3):
            wanted = key[own] + (dx * (_BLOCK + 2) + dy) * tall + dz
            place = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
            near.append(np.where(key[order[place]] == wanted, order[place], -1))
        out = table.take(pa.array(own)).drop_columns(["__bx", "__by"])
        for name, values in look(table, own, near).items():
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
        return out

    schema = StructType([*cells.schema.fields, *StructType.fromDDL(more).fields])
    return dealt.groupBy("__bx", "__by").applyInArrow(run, schema)


def drop_nearby(points: DataFrame, distance: float) -> DataFrame:
    """Points with an earlier point within one step of round(v / distance) on every axis go.

    Of each cell only the first point can stay; it does if no neighbouring cell has an earlier one.
    """
    q = points.withColumns({f"q{a}": nearest(xyz(a) / distance) for a in "xyz"})
    window = Window.partitionBy("qx", "qy", "qz").orderBy(*ORDER)
    first = q.withColumn("__k", F.row_number().over(window)).where("__k = 1").drop("__k")

    def look(table: pa.Table, own: np.ndarray, near: list[np.ndarray]) -> dict[str, np.ndarray]:
        rank = np.empty(len(table), np.int64)
        rank[pc.sort_indices(table, [(c, "ascending") for c in ORDER]).to_numpy()] = np.arange(len(table))
        least = rank[own]
        for rows in near:
            least = np.minimum(least, np.where(rows >= 0, rank[rows], len(table)))
        return {"__stays": least == rank[own]}

    return _around(first, ("qx", "qy", "qz"), look, "__stays boolean").where("__stays").select(*points.columns)


def mark_noise(points: DataFrame, step: float = 4.0, isolated: int = 5, step_z: float | None = None) -> DataFrame:
    """Adds is_noise: at most `isolated` points in the 27 cells around the point. Cells are counted, not points joined."""
    steps = {"x": step, "y": step, "z": step_z or step}
    q = points.withColumns({f"q{a}": F.floor(xyz(a) / s) for a, s in steps.items()})
    cells = q.groupBy("qx", "qy", "qz").agg(F.count(F.lit(1)).alias("n"))

    def look(table: pa.Table, own: np.ndarray, near: list[np.ndarray]) -> dict[str, np.ndarray]:
        n = table.column("n").to_numpy()
        return {"around": sum(np.where(rows >= 0, n[rows], 0) for rows in near).astype(np.int64)}

    around = _around(cells, ("qx", "qy", "qz"), look, "around long").drop("n")
    return q.join(around, ["qx", "qy", "qz"]).withColumn("is_noise", F.col("around") <= isolated).select(*points.columns, "is_noise")


def connected_cells(points: DataFrame, step: float, cut: float) -> DataFrame:
    """qx, qy, qz, n and component of the occupied cells of step x step x cut: cells that touch, also by a corner, are of one component.

    A block links its own cells and those at its edge in one pass, and only what it found goes on: an
    edge from each cell at a block's rim to its part of the block. Components of the whole cloud then are those of the parts.
    """
    steps = {"x": step, "y": step, "z": cut}
    cells = points.groupBy(*[F.floor(xyz(a) / s).alias(f"q{a}") for a, s in steps.items()]).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells.withColumn("id", F.monotonically_increasing_id()), "cells")

    def look(table: pa.Table, own: np.ndarray, near: list[np.ndarray]) -> dict[str, np.ndarray]:
        ids = table.column("id").to_numpy()
        heads, tails = np.concatenate([own[rows >= 0] for rows in near]), np.concatenate([rows[rows >= 0] for rows in near])
        label = np.arange(len(ids))  # rows of this block; every cell's label goes down to the least of its part
        while True:
            least = label.copy()
            np.minimum.at(least, heads, label[tails])
            np.minimum.at(least, tails, label[heads])
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        foreign = np.ones(len(ids), bool)
        foreign[own] = False
        crossing = foreign[tails]
        pairs = pd.Series(ids[tails[crossing]]).groupby(heads[crossing]).agg(lambda v: sorted(set(v))).to_dict()
        return {"part": ids[label[own]], "beyond": pa.array([pairs.get(i, []) for i in own.tolist()], pa.list_(pa.int64()))}

    linked = written(_around(cells, ("qx", "qy", "qz"), look, "part long, beyond array<long>"), "parts")
    edges = linked.select(F.col("id").alias("u"), F.col("part").alias("v"))
    edges = edges.union(linked.select(F.col("part").alias("u"), F.explode("beyond").alias("v")))
    found = components(edges)
    named = linked.join(found, F.col("id") == F.col("node"), "left")
    return named.select("qx", "qy", "qz", "n", F.coalesce("component", "id").alias("component"))


def mark_unconnected(points: DataFrame, step: float, cut: float = 0.5, least: int = 10_000) -> DataFrame:
    """Adds is_noise: the point's component of cells (see `connected_cells`) holds fewer than `least` points. A drop of more than two `cut` between neighbouring places cuts them apart."""
    cells = connected_cells(points, step, cut)
    sizes = cells.groupBy("component").agg(F.sum("n").alias("size"))
    told = cells.join(sizes, "component").select("qx", "qy", "qz", "size")
    q = points.withColumns({f"q{a}": F.floor(xyz(a) / s) for a, s in {"x": step, "y": step, "z": cut}.items()})
    return q.join(told, ["qx", "qy", "qz"]).withColumn("is_noise", F.col("size") < least).select(*points.columns, "is_noise")


def voxels(points: DataFrame, step: float) -> DataFrame:
    """vx, vy, vz, n and the mean intensity of each occupied cube."""
    cube = [F.floor(xyz(a) / step).alias(f"v{a}") for a in "xyz"]
    return points.groupBy(*cube).agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("intensity"))
