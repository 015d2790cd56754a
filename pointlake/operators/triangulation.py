"""The Delaunay triangulation of a cloud of any size: tasks of bounded size, the same triangles on either side of every border.

A stage deals the points to tiles and triangulates each with a margin around it. A triangle is
certain if its circumcircle lies within what its tile knows (the tile and its margin): no point
of the cloud can be in it. It is given out by the tile of its first corner. Points whose
triangles are all certain are finished. The others (along wide gaps and at the rim of the cloud)
are the next stage's points, which are few and meet in larger tiles; each brings the sectors
around it that are triangulated already. What they form in the sectors that are left are
triangles of the whole cloud: it has those triangles, their corners are all among these points,
and leaving out other points doesn't take them away. When all that is left fits one tile, there
is nothing outside, and every triangle is certain.

Tiles are quadrants, halved until the quadrant and its eight neighbours hold at most `most`
points, so a task never has more than that, however uneven the cloud. Coordinates are the
points' integers, so every test is exact; of points on one circle a fixed number drawn from
their coordinates decides, alike in every tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.tables import written
from pointlake.schema import DEFAULT_SCALE

CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]
_RAW = ", ".join(f"{c} long" for c in CORNERS)


def tie_breaks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number of 30 bits for each place."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(34)).astype(np.int64)


def _along_a_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order in which neighbours follow each other: rows of cells, to and fro, and within a cell by place."""
    span = max(int(x.max() - x.min()), int(y.max() - y.min()), 1)
    side = max(span / max(math.sqrt(len(x) / 4), 1), 1)
    row, col = ((y - y.min()) / side).astype(np.int64), ((x - x.min()) / side).astype(np.int64)
    return np.lexsort((y, x, np.where(row % 2 == 0, col, -col), row))


def _turn(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, wide: bool = True) -> np.ndarray:
    """Numbers with the sign of the turn from i over j to k (positive: to the left); exact. wide: differences may have more than 31 bits."""
    xi, yi = x[i], y[i]
    ux, uy, vx, vy = x[j] - xi, y[j] - yi, x[k] - xi, y[k] - yi
    if not wide:
        return ux * vy - uy * vx
    p, q = ux.astype(float) * vy, uy.astype(float) * vx
    out = p - q
    for at in np.flatnonzero(np.abs(out) <= 1e-15 * (np.abs(p) + np.abs(q))).tolist():
        exact = int(ux[at]) * int(vy[at]) - int(uy[at]) * int(vx[at])
        out[at] = (exact > 0) - (exact < 0)
    return out


def _holds(x: np.ndarray, y: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the circles of the triangles (i, j, k) hold p: by doubles where their error can't matter, else by integers."""
    d = [v[c] - v[p] for c in (i, j, k) for v in (x, y)]

    def parts(ax, ay, bx, by, cx, cy):  # noqa: ANN001, ANN202
        return (ax * ax + ay * ay, bx * cy, by * cx), (bx * bx + by * by, cx * ay, cy * ax), (cx * cx + cy * cy, ax * by, ay * bx)

    near = parts(*(v.astype(float) for v in d))
    inside = sum(size * (s - t) for size, s, t in near)
    unsure = np.flatnonzero(np.abs(inside) <= 1.2e-15 * sum(size * (np.abs(s) + np.abs(t)) for size, s, t in near))
    out = inside > 0
    if len(unsure):
        short = np.max([np.abs(v[unsure]) for v in d], axis=0) < 2**14
        for some, kind in ((unsure[short], np.int64), (unsure[~short], object)):
            if len(some):
                exact = parts(*(v[some].astype(kind) for v in d))
                inside = sum(size * (s - t) for size, s, t in exact)
                tie = sum((weight[c[some]] - weight[p[some]]).astype(kind) * (s - t) for c, (_, s, t) in zip((i, j, k), exact, strict=True))
                out[some] = np.where(inside == 0, tie > 0, inside > 0).astype(bool)
    return out


def _hull_corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; what lies well within the extremes of eight directions is left out first."""
    ends = [f(v) for v in (x, x + y, y, y - x) for f in (np.argmin, np.argmax)]
    ring = np.array([ends[0], ends[3 - 1], ends[4], ends[7], ends[1], ends[3], ends[5], ends[6]])
    ring = ring[np.argsort(np.arctan2(y[ring] - y[ring].mean(), x[ring] - x[ring].mean()), kind="stable")]
    within = np.ones(len(x), bool)
    for a, b in zip(ring.tolist(), np.roll(ring, -1).tolist(), strict=True):
        if (x[a], y[a]) != (x[b], y[b]):
            left = (x[b] - x[a]).astype(float) * (y - y[a]) - (y[b] - y[a]).astype(float) * (x - x[a])
            within &= left > 1e-9 * (abs(float(x[b] - x[a])) + abs(float(y[b] - y[a]))) * max(float(np.ptp(x)), float(np.ptp(y)))
    rest = np.flatnonzero(~within)
    rows = [(int(x[k]), int(y[k]), k) for k in rest[np.lexsort((y[rest], x[rest]))].tolist()]

    def half(points: list[tuple]) -> list[int]:
        out: list[tuple] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return [q[2] for q in out[:-1]]

    return np.array(half(rows) + half(rows[::-1]), np.int64)


class Mesh:
    """The Delaunay triangles of distinct places with integer coordinates: `tri` (corners counter-clockwise) and `twin`.

    Edge 3 t + k lies opposite corner k of triangle t; its twin is the same edge of the triangle behind it, -1 on the hull.
    All steps are array operations. The hull's polygon is halved into triangles. In each round every
    triangle takes in one of the places in it and is cut in three, then edges whose circles hold
    the corner behind them are flipped, as many at once as share no triangle, until none is
    left. A place on an edge makes a triangle without area, which is flipped away; on the hull it
    stays until the end, and takes in no place. Places are kept along a curve, so that neighbours lie near each other; `order` has their numbers.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        n = len(x)
        self.order = _along_a_curve(x, y) if n else np.zeros(0, np.int64)
        self.x, self.y = x, y = x[self.order], y[self.order]
        self.weight, self.wide = tie_breaks(x, y), self._wide()
        self.tri, self.twin = np.zeros((2 * n + 4, 3), np.int64), np.full(3 * (2 * n + 4), -1, np.int64)
        self.count, self.to, self.once = 0, np.arange(len(self.twin)), np.zeros(len(self.twin), np.int64)
        self.owner, self.changed = np.zeros(len(self.tri), np.int64), np.zeros(len(self.tri), bool)
        hull = _hull_corners(x, y) if n > 2 else np.zeros(0, np.int64)
        if len(hull) > 2:
            self._polygon(hull)
            rest, self.draw = np.delete(np.arange(n), hull), np.random.default_rng(0)
            at = self.walk(rest, np.zeros(len(rest), np.int64))
            while len(rest):
                self.changed[: self.count] = False
                taken = self._insert(rest, at)
                rest, at = rest[~taken], at[~taken]
                moved = self.changed[at]
                at[moved] = self.walk(rest[moved], at[moved])

    def _wide(self) -> bool:
        return len(self.x) > 0 and max(int(v.max()) - int(v.min()) for v in (self.x, self.y)) >= 2**31

    def _turn(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        return _turn(self.x, self.y, i, j, k, self.wide)

    def triangles(self) -> np.ndarray:
        tri = self.tri[: self.count]
        return tri[self._turn(tri[:, 0], tri[:, 1], tri[:, 2]) > 0]

    def _polygon(self, hull: np.ndarray) -> None:
        todo, tri = [(0, len(hull) - 1)], []
        while todo:
            i, j = todo.pop()
            if j - i > 1:
                tri.append((i, (i + j) // 2, j))
                todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
        edges = {(t[k - 2], t[k - 1]): 3 * n + k for n, t in enumerate(tri) for k in range(3)}
        self.count = len(tri)
        self.tri[: self.count] = hull[np.array(tri)]
        for (i, j), h in edges.items():
            self.twin[h] = edges.get((j, i), -1)
        self._flip(np.arange(3 * self.count))

    def _relink(self, old: np.ndarray, new: np.ndarray) -> None:
        """Edges old (all of them outer edges of what was changed) are now called new."""
        behind = self.twin[old]
        self.to[old] = new
        behind = np.where(behind < 0, -1, self.to[behind])
        self.to[old] = old
        self.twin[new] = behind
        some = behind >= 0
        self.twin[behind[some]] = new[some]

    def _insert(self, rest: np.ndarray, at: np.ndarray) -> np.ndarray:
        drawn = self.draw.permutation(len(at))
        self.owner[at[drawn]] = drawn
        taken = self.owner[at] == np.arange(len(at))
        chosen = np.zeros(self.count, bool)
        chosen[at] = True
        p, t = rest[taken], at[taken]
        wait = np.zeros(len(p), bool)  # of two places on one edge, taken by the triangles on its sides, one waits
        for k in range(3):
            behind = self.twin[3 * t + k]
            on = self._turn(self.tri[t, k - 2], self.tri[t, k - 1], p) == 0
            wait |= on & (behind >= 0) & chosen[behind // 3] & (behind // 3 > t)
        taken[np.flatnonzero(taken)[wait]] = False
        p, t = p[~wait], t[~wait]
        a, b, c = self.tri[t].T
        one, two = (self.count + np.arange(len(t)) + m * len(t) for m in (0, 1))
        self.count += 2 * len(t)
        self._relink(np.concatenate([3 * t, 3 * t + 1, 3 * t + 2]), np.concatenate([3 * t, 3 * one, 3 * two]))
        for at_, corners in ((t, (p, b, c)), (one, (p, c, a)), (two, (p, a, b))):
            self.tri[at_] = np.column_stack(corners)
            self.changed[at_] = True
        for g, h in ((3 * t + 1, 3 * one + 2), (3 * t + 2, 3 * two + 1), (3 * one + 1, 3 * two + 2)):
            self.twin[g], self.twin[h] = h, g
        self._flip(np.concatenate([3 * t, 3 * one, 3 * two]))
        return taken

    def _flip(self, edges: np.ndarray) -> None:
        while len(edges):
            back = self.twin[edges]
            edges = np.maximum(edges, back)[back >= 0]
            self.once[edges] = np.arange(len(edges))
            edges = edges[self.once[edges] == np.arange(len(edges))]
            back = self.twin[edges]
            t, k, s, m = edges // 3, edges % 3, back // 3, back % 3
            p, a, b, q = self.tri[t, k], self.tri[t, k - 2], self.tri[t, k - 1], self.tri[s, m]
            bad = _holds(self.x, self.y, self.weight, p, a, b, q)
            edges, t, k, s, m, p, a, b, q = (v[bad] for v in (edges, t, k, s, m, p, a, b, q))
            self.owner[np.column_stack([t, s]).ravel()] = np.repeat(np.arange(len(t)), 2)
            won = (self.owner[t] == np.arange(len(t))) & (self.owner[s] == np.arange(len(t)))
            later = edges[~won]
            t, k, s, m, p, a, b, q = (v[won] for v in (t, k, s, m, p, a, b, q))
            outer = np.concatenate([3 * s + (m + 1) % 3, 3 * t + (k + 2) % 3, 3 * t + (k + 1) % 3, 3 * s + (m + 2) % 3])
            new = np.concatenate([3 * t, 3 * t + 2, 3 * s, 3 * s + 2])
            self._relink(outer, new)
            self.tri[t], self.tri[s] = np.column_stack([p, a, q]), np.column_stack([q, b, p])
            self.twin[3 * t + 1], self.twin[3 * s + 1] = 3 * s + 1, 3 * t + 1
            self.changed[t] = self.changed[s] = True
            edges = np.concatenate([later, new])

    def _apart(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Below zero where k, on the line through i and j, lies between them."""
        x, y = self.x, self.y
        return (x[i] - x[k]).astype(float) * (x[j] - x[k]) + (y[i] - y[k]).astype(float) * (y[j] - y[k])

    def walk(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The triangle of each place (an index), from at; -1 beyond the hull."""
        at, left = at.copy(), np.arange(len(places))
        while len(left):
            p, t = places[left], at[left]
            to = np.full(len(left), -1)
            for k in range(3):
                to = np.where((to < 0) & (self._turn(self.tri[t, k - 2], self.tri[t, k - 1], p) < 0), k, to)
            there = np.flatnonzero(to < 0)
            there = there[self._turn(*self.tri[t[there]].T) == 0]
            for k in range(3) if len(there) else ():  # without area: inwards through a shorter edge, that which holds the place if one does
                i, j, c = (self.tri[t[there], k - m] for m in (2, 1, 0))
                to[there[(self._apart(i, j, c) > 0) & ((self._apart(i, j, p[there]) <= 0) | (to[there] < 0))]] = k
            left, t, to = left[to >= 0], t[to >= 0], to[to >= 0]
            at[left] = self.twin[3 * t + to] // 3
            left = left[at[left] >= 0]
        return at

    def heights(self, z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The surface through the corners' z at places with integer coordinates; NaN beyond the hull."""
        n, out = len(self.order), np.full(len(x), np.nan)
        if not self.count or not len(x):
            return out
        touching = np.zeros(n, np.int64)
        touching[self.tri[: self.count].T] = np.arange(self.count)
        own = (self.x, self.y, self.wide)
        both = [np.concatenate(v) for v in zip(own[:2], (x, y), strict=True)]
        order = _along_a_curve(*both)
        mine = order < n  # on the curve each place begins at the corner before it
        corner = np.maximum.accumulate(np.where(mine, np.arange(len(order)), 0))
        start = np.where(mine[corner], order[corner], order[np.flatnonzero(mine)[0]])
        places = order[~mine]
        self.x, self.y = both
        self.wide = self._wide()
        at = self.walk(places, touching[start[~mine]])
        places, at = places[at >= 0], at[at >= 0]
        i, j, k = self.tri[at].T
        w = [self._turn(a, b, places).astype(float) for a, b in ((j, k), (k, i), (i, j))]
        self.x, self.y, self.wide = own
        z = z[self.order]
        out[places - n] = (w[0] * z[i] + w[1] * z[j] + w[2] * z[k]) / (w[0] + w[1] + w[2])
        return out


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles (corners counter-clockwise) over distinct places with integer coordinates; none for fewer than three or a single line."""
    mesh = Mesh(np.asarray(x, np.int64), np.asarray(y, np.int64))
    return mesh.order[mesh.triangles()]


def _first_corner_first(tri: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    place = np.empty(len(x), np.int64)
    place[np.lexsort((y, x))] = np.arange(len(x))
    first = place[tri].argmin(1)
    return tri[np.arange(len(tri))[:, None], (first[:, None] + np.arange(3)) % 3]


def _circles(tri: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii; every tile computes them from the first corner, and so the same ones."""
    ax, ay = x[tri[:, 0]].astype(float), y[tri[:, 0]].astype(float)
    bx, by, cx, cy = (v[tri[:, k]] - v[tri[:, 0]] for k in (1, 2) for v in (x, y))
    bx, by, cx, cy = bx.astype(float), by.astype(float), cx.astype(float), cy.astype(float)
    d, bb, cc = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
        return ax + ux, ay + uy, np.hypot(ux, uy) * (1 + 1e-6) + 1


def _within(circles: tuple[np.ndarray, np.ndarray, np.ndarray], box: np.ndarray) -> np.ndarray:
    cx, cy, r = circles
    with np.errstate(invalid="ignore"):
        return (cx - r >= box[:, 0]) & (cy - r >= box[:, 1]) & (cx + r <= box[:, 2]) & (cy + r <= box[:, 3])


def _less(a: tuple, b: tuple) -> tuple:
    return a[0] - b[0], a[1] - b[1]


def _between(s: tuple, e: tuple, d: tuple) -> bool:
    """Whether the direction just after d, counter-clockwise, lies in the sector from s to e."""
    return s[0] * d[1] >= s[1] * d[0] and d[0] * e[1] > d[1] * e[0]


def _close(open_: np.ndarray, own: np.ndarray, tri: np.ndarray, settled: np.ndarray, places: list[tuple], around: dict[tuple, list]) -> None:
    """Of the open points those are done after all whose gaps, between the sectors around them, are filled by settled triangles."""
    after: dict[tuple, int] = {}
    for a, b, c in tri[settled].tolist():
        after[a, b], after[b, c], after[c, a] = c, a, b
    at = {p: i for i, p in enumerate(places)}
    for v in np.flatnonzero(open_ & own).tolist():
        sectors = around.get(places[v])
        if not sectors:
            continue
        starts, ends = {s for s, _ in sectors}, {e for _, e in sectors}
        filled = True
        for gap in ends - starts:
            c = at.get(gap)
            while c is not None and places[c] not in starts:
                c = after.get((v, c))
            filled &= c is not None
        open_[v] = not filled


def _triangulate(frame: pd.DataFrame) -> pd.DataFrame:
    """A tile's triangles (kind 0), the points that aren't finished (1), and the sectors around points that others may need (2)."""
    rows, sectors = frame[frame["kind"] == 1], frame[frame["kind"] == 2]
    x, y, z = (rows[c].to_numpy(np.int64) for c in ("x0", "y0", "z0"))
    own, box = rows["own"].to_numpy(bool), rows[["left", "low", "right", "high"]].to_numpy(float)
    tri = _first_corner_first(delaunay(x, y), x, y)
    circles = _circles(tri, x, y)
    known = np.isinf(box[own][0]).all() | _within(circles, np.repeat(box[own][:1], len(tri), 0)) if own.any() else np.zeros(len(tri), bool)
    certain = np.isinf(box[tri[:, 0]]).all(1) | _within(circles, box[tri[:, 0]])

    around: dict[tuple, list] = {}
    for vx, vy, sx, sy, ex, ey in sectors[["x0", "y0", "x1", "y1", "x2", "y2"]].itertuples(index=False, name=None):
        around.setdefault((vx, vy), []).append(((sx, sy), (ex, ey)))
    everything = own.any() and bool(np.isinf(box[own][0]).all())
    places = list(zip(x.tolist(), y.tolist(), strict=True))

    old = np.zeros(len(tri), bool)
    if around:
        for t in np.flatnonzero(certain & own[tri[:, 0]]).tolist():
            v, d = places[tri[t, 0]], places[tri[t, 1]]
            old[t] = any(_between(_less(s, v), _less(e, v), _less(d, v)) for s, e in around.get(v, ()))
    # points with a triangle that isn't settled, or at the rim of what is known
    open_ = np.zeros(len(x), bool)
    if not everything:
        settled = known & certain
        open_[tri[~settled]] = True
        seen = np.zeros(len(x), bool)
        seen[tri] = True
        heads, tails = tri.ravel(), tri[:, [1, 2, 0]].ravel()
        rim = ~np.isin(heads * len(x) + tails, tails * len(x) + heads)
        open_[heads[rim]] = open_[tails[rim]] = True
        open_ |= ~seen
        if around:
            _close(open_, own, tri, settled, places, around)
    open_ &= own
    done = own & ~open_
    given = tri[~old & certain & own[tri[:, 0]]]

    def table(kind: int, *points: np.ndarray) -> pd.DataFrame:
        cols = {f"{c}{k}": v[p] for k, p in enumerate(points) for c, v in zip("xyz", (x, y, z), strict=True)}
        return pd.DataFrame({"kind": np.full(len(points[0]), kind, np.int32)} | {c: cols.get(c, np.zeros(len(points[0]), np.int64)) for c in CORNERS})

    out = [table(0, given[:, 0], given[:, 1], given[:, 2]), table(1, np.flatnonzero(open_))]
    for k in range(3):
        v = given[~done[given[:, k]]]
        out.append(table(2, v[:, k], v[:, (k + 1) % 3], v[:, (k + 2) % 3]))
    still = {(int(x[v]), int(y[v])) for v in np.flatnonzero(open_)}
    stays = [at in still for at in zip(sectors["x0"].tolist(), sectors["y0"].tolist(), strict=True)]
    out.append(sectors[np.array(stays, bool)][["kind", *CORNERS]])
    return pd.concat(out)


def _cell(value: Column, shift: Column | int) -> Column:
    return F.shiftright(value, shift) if isinstance(shift, int) else F.call_function("shiftright", value, shift.cast("int"))


def _leaves(points: DataFrame, size: int, n: int, most: int) -> tuple[DataFrame, int]:
    """(cells, level): the occupied cells of a level, each with its tile and every tile whose margin it meets.

    points: x0 and y0 from 0 to 2**size - 1. cells: bc, br, level, col, row (the tile), home_level, home_col, home_row.
    """
    level = min(size, max(0, math.ceil(math.log(max(n * 36 / most, 1), 4))) + 1)
    while True:
        base = points.groupBy(_cell(F.col("x0"), size - level).alias("bc"), _cell(F.col("y0"), size - level).alias("br")).agg(F.count(F.lit(1)).alias("n"))
        base = written(base, "tin-cells")
        up = F.lit(level) - F.col("level")
        each = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(level)))).withColumns({"col": _cell(F.col("bc"), up), "row": _cell(F.col("br"), up)})
        cells = each.groupBy("level", "col", "row").agg(F.sum("n").alias("n"))
        near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        spread = cells.withColumn("dc", near).withColumn("dr", near)
        around = spread.groupBy("level", (F.col("col") + F.col("dc")).alias("col"), (F.col("row") + F.col("dr")).alias("row")).agg(F.sum("n").alias("around"))
        fit = around.where(F.col("around") <= most).select("level", "col", "row")
        homes = each.join(fit, ["level", "col", "row"]).groupBy("bc", "br").agg(F.min("level").alias("home_level"))
        if level == size or homes.count() == base.count():
            break
        level = min(size, level + 2)
    homes = base.join(homes, ["bc", "br"], "left").withColumn("home_level", F.coalesce("home_level", F.lit(level)))
    up = F.lit(level) - F.col("home_level")
    homes = homes.select("bc", "br", "home_level", _cell(F.col("bc"), up).alias("home_col"), _cell(F.col("br"), up).alias("home_row"))
    homes = written(homes, "tin-homes")
    tiles = homes.select(F.col("home_level").alias("level"), F.col("home_col").alias("col"), F.col("home_row").alias("row")).distinct()
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())  # at most `size` and one
    side, margin = _cell(F.lit(1 << size), F.col("level")), F.greatest(_cell(F.lit(1 << size), F.col("level") + 3), F.lit(1))
    reach = lambda b: F.sequence(F.floor((F.shiftleft(F.col(b), size - level) - margin) / side), F.floor((F.shiftleft(F.col(b) + 1, size - level) - 1 + margin) / side))
    asked = homes.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("col", F.explode(reach("bc"))).withColumn("row", F.explode(reach("br")))
    return written(asked.join(tiles, ["level", "col", "row"]), "tin-tiles"), level


def deal(points: DataFrame, n: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows, homes): points (x0, y0 and any columns), n in number, by tile (level, col, row): `own` once in their own tile, and in those whose margin they are in.

    left, low, right and high are what the point's own tile knows. homes: the occupied cells (bc, br, and their
    `shift` and origin) with their tiles; None if all is one tile, which knows everything.
    """
    if n <= most:
        infinite = [F.lit(float(s)).alias(c) for c, s in (("left", "-inf"), ("low", "-inf"), ("right", "inf"), ("high", "inf"))]
        tile = [F.lit(0).alias("level"), F.lit(0).cast("long").alias("col"), F.lit(0).cast("long").alias("row")]
        return points.select("*", F.lit(True).alias("own"), *infinite, *tile), None
    low_x, low_y, high_x, high_y = points.agg(F.min("x0"), F.min("y0"), F.max("x0"), F.max("y0")).first()
    size = max(int(max(high_x - low_x, high_y - low_y)).bit_length(), 1)
    moved = points.select(*points.columns, (F.col("x0") - low_x).alias("__x"), (F.col("y0") - low_y).alias("__y"))
    cells, level = _leaves(moved.select(F.col("__x").alias("x0"), F.col("__y").alias("y0")), size, n, most)
    base = {"bc": _cell(F.col("__x"), size - level), "br": _cell(F.col("__y"), size - level)}
    met = moved.withColumns(base).join(cells, ["bc", "br"])

    def box(prefix: str) -> list[Column]:
        side, margin = (F.greatest(_cell(F.lit(1 << size), F.col(f"{prefix}level") + k), F.lit(1)) for k in (0, 3))
        c, r = F.col(f"{prefix}col") * side, F.col(f"{prefix}row") * side
        return [c - margin, r - margin, c + side + margin, r + side + margin]

    left, below, right, above = box("")
    met = met.where((F.col("__x") >= left) & (F.col("__x") < right) & (F.col("__y") >= below) & (F.col("__y") < above))
    own = (F.col("level") == F.col("home_level")) & (F.col("col") == F.col("home_col")) & (F.col("row") == F.col("home_row"))
    home = [(v + F.lit(m)).cast("double").alias(c) for v, m, c in zip(box("home_"), (low_x, low_y, low_x - 1, low_y - 1), ("left", "low", "right", "high"), strict=True)]
    homes = cells.select("bc", "br", F.col("home_level").alias("level"), F.col("home_col").alias("col"), F.col("home_row").alias("row")).distinct()
    homes = homes.withColumns({"shift": F.lit(size - level), "low_x": F.lit(low_x), "low_y": F.lit(low_y)})
    return met.select(*points.columns, own.alias("own"), *home, "level", "col", "row"), homes


def _stage(points: DataFrame, sectors: DataFrame | None, n: int, most: int) -> DataFrame:
    """One stage over points (x0, y0, z0) and the sectors around them that are done: rows of `_triangulate`."""
    dealt, homes = deal(points, n, most)
    rows = dealt.withColumn("kind", F.lit(1))
    if sectors is not None:
        if homes is None:
            around = sectors.select("*", F.lit(0).alias("level"), F.lit(0).cast("long").alias("col"), F.lit(0).cast("long").alias("row"))
        else:
            shift, low_x, low_y = homes.select("shift", "low_x", "low_y").first()
            cell_of = {"bc": _cell(F.col("x0") - low_x, shift), "br": _cell(F.col("y0") - low_y, shift)}
            around = sectors.withColumns(cell_of).join(homes.drop("shift", "low_x", "low_y"), ["bc", "br"]).drop("bc", "br")
        rows = rows.unionByName(around, allowMissingColumns=True)
    have = set(rows.columns)
    rows = rows.select("level", "col", "row", "kind", "own", "left", "low", "right", "high", *[c if c in have else F.lit(0).cast("long").alias(c) for c in CORNERS])
    return rows.groupBy("level", "col", "row").applyInPandas(_triangulate, f"kind int, {_RAW}")


def raw_triangles(points: DataFrame, most: int = 150_000) -> DataFrame:
    """x0 ... z2 as the points' integers: the Delaunay triangles of all places of points (xi, yi, zi); of points at one place the lowest counts.

    Points with a null coordinate take no part; fewer than three places, or places on one line,
    give no triangle. A task holds at most `most` points, on even clouds about a sixth of that.
    """
    places = points.where("xi IS NOT NULL AND yi IS NOT NULL AND zi IS NOT NULL").groupBy("xi", "yi").agg(F.min("zi").alias("zi"))
    at = [F.col(f"{c}i").cast("long").alias(f"{c}0") for c in "xyz"]
    left = written(places.select(*at), "tin-points")
    n, out, sectors = left.count(), [], None
    while n:
        rows = written(_stage(left, sectors, n, most), "tin-stage")
        out.append(rows.where("kind = 0").drop("kind"))
        left = rows.where("kind = 1").select("x0", "y0", "z0")
        more = left.count()
        sectors = rows.where("kind = 2").join(left.select("x0", "y0"), ["x0", "y0"], "left_semi").select("kind", *CORNERS)
        if more > n * 0.9:  # gaps wider than the tiles all over: larger tiles
            most *= 4
        n = more
    empty = left.sparkSession.createDataFrame([], _RAW)
    for rows in out:
        empty = empty.union(rows.select(*CORNERS))
    return empty


def tin(points: DataFrame, most: int = 150_000) -> DataFrame:
    """x0, y0, z0 ... x2, y2, z2: the Delaunay triangles in metres, corners counter-clockwise; see `raw_triangles`."""
    real = [(F.col(c) * F.lit(DEFAULT_SCALE.scale["xyz".index(c[0])]) + F.lit(DEFAULT_SCALE.offset["xyz".index(c[0])])).alias(c) for c in CORNERS]
    return raw_triangles(points, most).select(*real)
