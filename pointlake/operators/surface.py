"""Surfaces: elevation rasters, contours, heights, ground and boundaries over the triangulation of a cloud.

The triangles are those of the whole cloud (`triangulation.tin`). What is behind them is column
arithmetic, grouping and joins by equality; ground is found in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.tables import written
from pointlake.operators.filters import xyz
from pointlake.operators.triangulation import CORNERS, Mesh, deal, tin
from pointlake.schema import DEFAULT_SCALE

__all__ = ["CORNERS", "boundary", "classify_ground", "classify_objects", "contours", "convex_hull", "dem", "height_above_ground", "heights_at", "hillshade", "normals", "tin", "without_long_edges"]


def without_long_edges(triangles: DataFrame, kill: float) -> DataFrame:
    """Triangles of which no edge is longer than kill."""
    edge = lambda a, b: F.hypot(F.col(f"x{a}") - F.col(f"x{b}"), F.col(f"y{a}") - F.col(f"y{b}")) <= kill
    return triangles.where(edge(0, 1) & edge(1, 2) & edge(2, 0))


def dem(triangles: DataFrame, step: float, kill: float = 100.0) -> DataFrame:
    """col, row and value: the surface at cell centres. Every triangle offers itself to the cells of its bounding box.

    The side of an edge on which a centre lies is computed from the same end for both of its triangles. A centre
    within a triangle so belongs to no other one and is given out at once; those on edges are grouped, and the least counts.
    """
    t = without_long_edges(triangles, kill)
    box = lambda a, f: f(*[F.col(f"{a}{k}") for k in range(3)])
    span = lambda a: F.sequence(F.ceil(box(a, F.least) / step - 0.5), F.greatest(F.ceil(box(a, F.least) / step - 0.5), F.floor(box(a, F.greatest) / step - 0.5)))
    edges = {}
    for k in range(3):
        (ax, ay), (bx, by) = ([F.col(f"{v}{(k + n) % 3}") for v in "xy"] for n in (1, 2))
        swap = (ax > bx) | ((ax == bx) & (ay > by))
        edges |= {f"p{k}": F.when(swap, bx).otherwise(ax), f"q{k}": F.when(swap, by).otherwise(ay), f"dx{k}": bx - ax, f"dy{k}": by - ay}
    c = t.select("z0", "z1", "z2", *[v.alias(n) for n, v in edges.items()], span("y").alias("rows"), F.explode(span("x")).alias("col"))
    c = c.select("*", F.explode("rows").alias("row"))
    x, y = (F.col("col") + 0.5) * step, (F.col("row") + 0.5) * step
    c = c.withColumns({f"w{k}": F.col(f"dx{k}") * (y - F.col(f"q{k}")) - F.col(f"dy{k}") * (x - F.col(f"p{k}")) for k in range(3)}).where("w0 >= 0 AND w1 >= 0 AND w2 >= 0 AND w0 + w1 + w2 > 0")
    z = (F.col("w0") * F.col("z0") + F.col("w1") * F.col("z1") + F.col("w2") * F.col("z2")) / (F.col("w0") + F.col("w1") + F.col("w2"))
    within = F.col("w0") * F.col("w1") * F.col("w2") > 0
    cells = c.select("col", "row", z.alias("value"), within.alias("within"))
    on_edges = cells.where("NOT within").groupBy("col", "row").agg(F.min("value").alias("value"))
    return cells.where("within").select("col", "row", "value").union(on_edges)


def normals(triangles: DataFrame) -> DataFrame:
    """Adds nx, ny and nz of unit length, upwards."""
    d = {f"{a}{k}": F.col(f"{a}{k}") - F.col(f"{a}0") for a in "xyz" for k in (1, 2)}
    nx, ny, nz = d["y1"] * d["z2"] - d["z1"] * d["y2"], d["z1"] * d["x2"] - d["x1"] * d["z2"], d["x1"] * d["y2"] - d["y1"] * d["x2"]
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    return triangles.withColumns({"nx": F.try_divide(nx, size), "ny": F.try_divide(ny, size), "nz": F.try_divide(nz, size)})


def hillshade(triangles: DataFrame, step: float, light: tuple[float, float, float] = (1.0, 1.0, 2.0), kill: float = 100.0) -> DataFrame:
    """col, row and value (0 to 255): the shade at corners, from the sum of the normals of all triangles that meet there, and between them linearly.

    The normals of one corner's triangles are added up where they meet; a shade is the size of the sum's part along the light.
    """
    size = sum(v * v for v in light) ** 0.5
    faces = normals(triangles)
    tri = [f"{c}{k}" for k in range(3) for c in "xy"]
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)]))
    each = faces.select(*tri, "nx", "ny", "nz", corner.alias("c")).select(*tri, "nx", "ny", "nz", "c.*")
    summed = each.groupBy("x", "y").agg(*[F.sum(n).alias(f"s{n}") for n in ("nx", "ny", "nz")])
    length = F.sqrt(sum((F.col(f"s{n}") * F.col(f"s{n}") for n in ("nx", "ny", "nz")), F.lit(0.0)))
    lit = sum((F.col(f"s{n}") * (v / size) for n, v in zip(("nx", "ny", "nz"), light, strict=True)), F.lit(0.0))
    shades = summed.select("x", "y", (F.abs(F.try_divide(lit, length)) * 255).alias("shade"))
    back = each.select(*tri, "k", "x", "y").join(shades, ["x", "y"]).groupBy(*tri)
    shaded = back.agg(*[F.max(F.when(F.col("k") == k, F.col("shade"))).alias(f"z{k}") for k in range(3)])
    return dem(shaded.select(*CORNERS), step, kill)


def contours(triangles: DataFrame, every: float) -> DataFrame:
    """level, ax, ay, bx, by: where each triangle meets the levels; a corner on a level counts as above it."""
    zs = [F.col(f"z{k}") for k in range(3)]
    low, high = F.least(*zs), F.greatest(*zs)
    first, last = F.floor(low / every) + 1, F.floor(high / every)
    edges = {}  # both ends of each edge in the same order, and so cut at the same place, for the triangle on the other side
    for k in range(3):
        a, b = ([F.col(f"{c}{n}") for c in "xyz"] for n in (k, (k + 1) % 3))
        swap = (a[0] > b[0]) | ((a[0] == b[0]) & ((a[1] > b[1]) | ((a[1] == b[1]) & (a[2] > b[2]))))
        edges |= {f"{n}{c}{k}": F.when(swap, v).otherwise(w) for n, (v, w) in (("p", (b, a)), ("q", (a, b))) for c, v, w in zip("xyz", v, w, strict=True)}
    t = triangles.where("z0 IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL").where(last >= first).select(*[v.alias(n) for n, v in edges.items()], F.explode(F.sequence(first, last)).alias("level")).withColumn("level", F.col("level") * every)
    level = F.col("level")
    met = [(F.col(f"pz{k}") >= level) != (F.col(f"qz{k}") >= level) for k in range(3)]  # two of the edges or none
    cut = lambda c, k: F.col(f"p{c}{k}") + F.try_divide(level - F.col(f"pz{k}"), F.col(f"qz{k}") - F.col(f"pz{k}")) * (F.col(f"q{c}{k}") - F.col(f"p{c}{k}"))
    ends = {f"{n}{c}": F.when(met[k], cut(c, k)).otherwise(cut(c, 1)) for n, k in (("a", 0), ("b", 2)) for c in "xy"}
    return t.where(met[0] | met[1] | met[2]).select("level", *[v.alias(n) for n, v in ends.items()])


def _beyond(xy: np.ndarray, z: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
    """base with the height of the nearest corner where there is no surface."""
    out, outside = base.copy(), np.flatnonzero(np.isnan(base))
    for some in np.array_split(outside, len(outside) // 256 + 1):
        if len(some) and len(xy):
            out[some] = z[((at[some][:, None, :] - xy[None, :, :]) ** 2).sum(2).argmin(1)]
    return out


def _size_class(low: Column, high: Column) -> Column:
    """The power of two that is at least the larger extent, as its exponent."""
    return F.ceil(F.log2(F.greatest(high, low, F.lit(2.0**-20)))).cast("int")


def _levels(counts: dict[int, int]) -> list[int]:
    """Sizes of cells for triangles of so many sizes: that which nineteen in twenty fit, and smaller ones only where a fifth of all are much smaller."""
    below = lambda size: sum(n for k, n in counts.items() if k <= size)
    whole = sum(counts.values())
    levels = [min(k for k in counts if below(k) >= 0.95 * whole)] if counts else [0]
    while below(levels[-1] - 3) > 0.2 * whole:
        levels.append(levels[-1] - 3)
    return levels[::-1]


def heights_at(triangles: DataFrame, places: DataFrame, key: list[str], outside: bool = False) -> DataFrame:
    """key and surface: the height of the surface at places (key, x, y); places outside of it are missing, or (outside) have a null surface.

    A triangle is dealt to the cells that it meets, of a size that most triangles fit: those to the four at most
    that their box meets, longer ones to those along each column. A place looks into its cell of
    every level that there is, which is one unless the cloud is very uneven: a join by equality. At edges, where several triangles
    hold a place, heights are the same but for rounding; the least counts.
    """
    box = {f"{f}{a}": g(*[F.col(f"{a}{k}") for k in range(3)]) for a in "xy" for f, g in (("low", F.least), ("high", F.greatest))}
    t = triangles.select(*CORNERS, *[v.alias(n) for n, v in box.items()]).withColumn("size", _size_class(F.col("highx") - F.col("lowx"), F.col("highy") - F.col("lowy")))
    levels = _levels({r["size"]: r["count"] for r in t.groupBy("size").count().collect() if r["size"] is not None})  # exponents of doubles: some tens
    fit = F.lit(levels[-1])
    for level in reversed(levels):
        fit = F.when(F.col("size") <= level, level).otherwise(fit)
    t = t.withColumn("level", fit)
    side = F.pow(F.lit(2.0), F.col("level"))
    t = t.withColumn("cx", F.explode(F.sequence(F.floor(F.col("lowx") / side), F.floor(F.col("highx") / side))))
    low, high = F.col("lowy"), F.col("highy")
    left, right = F.col("cx") * side, (F.col("cx") + 1) * side
    ends = []  # where the edges enter and leave a column of cells
    for a, b in ((0, 1), (1, 2), (2, 0)):
        x, y = [F.col(f"x{k}") for k in (a, b)], [F.col(f"y{k}") for k in (a, b)]
        at = lambda v, x=x, y=y: y[0] + F.try_divide(v - x[0], x[1] - x[0]) * (y[1] - y[0])
        met = (F.least(*x) <= right) & (F.greatest(*x) >= left)
        ends += [F.when(met, F.coalesce(at(F.greatest(F.least(*x), left)), y[0])), F.when(met, F.coalesce(at(F.least(F.greatest(*x), right)), y[1]))]
    long = F.col("size") > F.col("level")
    slack = 1e-6 * side
    t = t.withColumn("from", F.when(long, F.greatest(low, F.least(*ends) - slack)).otherwise(low)).withColumn("to", F.when(long, F.least(high, F.greatest(*ends) + slack)).otherwise(high))
    t = t.withColumn("cy", F.explode(F.sequence(F.floor(F.col("from") / side), F.floor(F.greatest("from", "to") / side))))
    dealt = t.select("level", "cx", "cy", *CORNERS)
    at = places.select(*key, "x", "y", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    at = at.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    met = at.join(dealt, ["level", "cx", "cy"], "left" if outside else "inner")
    cross = lambda a, b: (F.col(f"x{b}") - F.col(f"x{a}")) * (F.col("y") - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (F.col("x") - F.col(f"x{a}"))
    w = [cross(1, 2), cross(2, 0), cross(0, 1)]
    whole = w[0] + w[1] + w[2]
    slack = -1e-9 * whole
    height = (w[0] * F.col("z0") + w[1] * F.col("z1") + w[2] * F.col("z2")) / whole
    inside = (w[0] >= slack) & (w[1] >= slack) & (w[2] >= slack) & (whole > 0)
    met = met.select(*key, F.when(inside, height).alias("surface")) if outside else met.where(inside).select(*key, height.alias("surface"))
    return met.groupBy(*key).agg(F.min("surface").alias("surface"))


def height_above_ground(points: DataFrame, ground_class: int = 2, most: int = 150_000) -> DataFrame:
    """source_file, point_index and height: z above the triangulated ground; null outside of it."""
    key = ["source_file", "point_index"]
    triangles = tin(points.where(F.col("classification") == ground_class), most)
    at = points.select(*key, *[xyz(a).alias(a) for a in "xyz"])
    return heights_at(triangles, at, [*key, "z"], outside=True).select(*key, (F.col("z") - F.col("surface")).alias("height"))


def classify_ground(points: DataFrame, step: float, offset: float, rounds: int = 3, most: int = 60_000) -> DataFrame:
    """source_file, point_index and is_ground: the lowest point of each cell of `step` begins a surface that grows.

    In each round the points within `offset` of the surface join it, and the surface is made
    anew; outside of it the nearest point of the surface counts. An approximation of bare earth by
    progressive densification, in tiles with margins that hold at most `most` points together
    (more only where so many share three raw units). Points with a null coordinate are left out.
    """
    scale, shift = DEFAULT_SCALE.scale, DEFAULT_SCALE.offset

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.reset_index(drop=True)
        raw, z = f[["x0", "y0"]].to_numpy(np.int64), f["zi"].to_numpy(float) * scale[2] + shift[2]
        xy = raw * np.array(scale[:2]) + np.array(shift[:2])
        cell = np.floor(xy / step).astype(np.int64)
        order = np.lexsort((z, cell[:, 1], cell[:, 0]))
        ground = np.zeros(len(f), bool)
        ground[order[np.r_[True, (np.diff(cell[order], axis=0) != 0).any(1)]]] = True
        for _ in range(rounds):
            at = np.flatnonzero(ground)
            at = at[np.lexsort((z[at], raw[at, 1], raw[at, 0]))]
            at = at[np.r_[True, (np.diff(raw[at], axis=0) != 0).any(1)]] if len(at) else at  # the lowest at each place
            base = _beyond(xy[at], z[at], xy, Mesh(raw[at, 0], raw[at, 1]).heights(z[at], raw[:, 0], raw[:, 1]))
            with np.errstate(invalid="ignore"):
                more = ground | (np.abs(z - base) <= offset)
            if (more == ground).all():
                break
            ground = more
        own = f["own"].to_numpy(bool)
        return f.loc[own, ["source_file", "point_index"]].assign(is_ground=ground[own])

    known = points.where("xi IS NOT NULL AND yi IS NOT NULL AND zi IS NOT NULL")
    rows = written(known.select("source_file", "point_index", F.col("xi").cast("long").alias("x0"), F.col("yi").cast("long").alias("y0"), "zi"), "ground-points")
    dealt, _ = deal(rows, rows.count(), most)
    return dealt.groupBy("level", "col", "row").applyInPandas(grow, "source_file string, point_index long, is_ground boolean")


def classify_objects(heights: DataFrame, points: DataFrame, planes: DataFrame, step: float, least: float = 2.0, flat: float = 0.05) -> DataFrame:
    """Points over `least` above ground become buildings (6) in planar cells and vegetation (5) elsewhere.

    planes: what `spatial.planes` gives for the same step; a cell is planar if its least
    eigenvalue is below `flat` of their sum. An approximation.
    """
    planar = planes.select(F.col("col").alias("__c"), F.col("row").alias("__r"), (F.col("e3") <= flat * (F.col("e1") + F.col("e2") + F.col("e3"))).alias("planar"))
    high = points.join(heights, ["source_file", "point_index"], "left")
    met = high.join(planar, (F.floor(xyz("x") / step) == F.col("__c")) & (F.floor(xyz("y") / step) == F.col("__r")), "left")
    to = F.when(F.col("height") > least, F.when(F.col("planar"), 6).otherwise(5)).otherwise(F.col("classification"))
    return met.withColumn("classification", to).select(*points.columns)


def boundary(triangles: DataFrame, concavity: float) -> DataFrame:
    """ax, ay, bx, by: edges that belong to one triangle only, once those with longer edges than concavity are gone."""
    t = without_long_edges(triangles, concavity)
    edge = lambda a, b: F.struct(*[F.col(f"{c}{k}").alias(f"{n}{c}") for n, k in (("a", a), ("b", b)) for c in "xy"])
    e = t.select(F.explode(F.array(edge(0, 1), edge(1, 2), edge(2, 0))).alias("e")).select("e.*")
    a, b = (F.struct(F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y")) for n in "ab")
    low, high = F.least(a, b), F.greatest(a, b)
    once = e.groupBy(low.alias("p"), high.alias("q")).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select(F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; exact for integers."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(points: list[list]) -> list[list]:
        out: list[list] = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def convex_hull(points: DataFrame) -> DataFrame:
    """x, y: corners of the hull. Bands offer only their own hulls' corners, and the hull of those is made in one task."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_hull(frame[["xi", "yi"]].to_numpy(np.int64)), columns=["xi", "yi"])

    edges = points.groupBy(F.col("yi")).agg(F.min("xi").alias("a"), F.max("xi").alias("b"))  # only a row's ends can be corners
    ends = edges.select("yi", F.explode(F.array("a", "b")).alias("xi"), F.floor(F.col("yi") / 4096).alias("g"))
    some = ends.groupBy("g").applyInPandas(of, "xi long, yi long")
    return some.groupBy().applyInPandas(of, "xi long, yi long")
