"""The triangulation: exact over the whole cloud, the same however it is cut into tiles."""

import math

import numpy as np
import pytest

from pointlake.operators import surface, triangulation
from pointlake.operators.triangulation import delaunay, raw_triangles
from tests.test_files_and_surfaces import _points


def canonical(corners):
    out = set()
    for t in np.asarray(corners).reshape(-1, 3, 2).tolist():
        t = [tuple(p) for p in t]
        k = t.index(min(t))
        out.add(tuple(t[k:] + t[:k]))
    return out


def circle_is_empty(p, tri):
    for a, b, c in p[tri].tolist():
        assert (b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0])
        for d in p.tolist():
            (ax, ay), (bx, by), (cx, cy) = ((q[0] - d[0], q[1] - d[1]) for q in (a, b, c))
            assert (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) <= 0


@pytest.mark.parametrize("places", [
    np.random.default_rng(0).integers(0, 15, (150, 2)), np.random.default_rng(1).integers(-(2**31), 2**31, (80, 2)),
    np.array([(i, j) for i in range(9) for j in range(9)]), np.array([(i, 0) for i in range(6)] + [(2, 1), (3, -4)]),
], ids=["dense", "wide", "grid", "line and two"])
def test_local(places):
    p = np.unique(places, axis=0)
    tri = delaunay(p[:, 0], p[:, 1])
    circle_is_empty(p, tri)
    area = sum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in p[tri].tolist())
    hull = surface._hull(p).tolist()
    assert area == sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(hull, [*hull[1:], hull[0]]))


def test_too_few_or_on_a_line():
    for p in ([], [(1, 1)], [(1, 1), (2, 2)], [(i, 3 * i) for i in range(5)]):
        a = np.array(p, np.int64).reshape(-1, 2)
        assert delaunay(a[:, 0], a[:, 1]).shape == (0, 3)


def test_time_is_nearly_linear():
    import time

    rng, took = np.random.default_rng(0), []
    for n in (5_000, 40_000):
        p = np.unique(rng.integers(0, 1_000_000, (n, 2)), axis=0)
        start = time.process_time()
        delaunay(p[:, 0], p[:, 1])
        took.append(time.process_time() - start)
    assert took[1] < 8 * 2.5 * took[0]


def test_steps_are_array_operations():
    """The number of calls doesn't grow with the places, neither to triangulate nor to find places in the triangles."""
    import sys

    p, made = np.unique(np.random.default_rng(0).integers(0, 1_000_000, (20_000, 2)), axis=0), []

    def count(frame, event, arg):
        if event == "call":
            made.append(1)

    sys.setprofile(count)
    try:
        mesh = triangulation.Mesh(p[:, 0], p[:, 1])
        mesh.heights(p[:, 0].astype(float), p[:, 1], p[:, 0])
    finally:
        sys.setprofile(None)
    assert len(made) < 20_000 < len(mesh.triangles())


@pytest.mark.parametrize("top", [9, 60, 2**31 - 1])
def test_heights_of_a_plane(top):
    """Places at corners, on edges and on the hull's edges have a height; places beyond have none."""
    rng = np.random.default_rng(top % 7)
    p = np.unique(np.concatenate([rng.integers(-top, top + 1, (300, 2)), [(-top, -top), (-top, top), (top, -top), (top, top)]]), axis=0)
    at = np.concatenate([p, rng.integers(-top, top + 1, (300, 2)), [(-top, 1), (top, 0), (1, top), (0, -top), (top + 1, 0), (top + 3, top), (-top - 1, -top)]])
    got = triangulation.Mesh(p[:, 0], p[:, 1]).heights(2.0 * p[:, 0] - p[:, 1], at[:, 0], at[:, 1])
    assert np.allclose(got[:-3], 2.0 * at[:-3, 0] - at[:-3, 1], rtol=1e-6) and np.isnan(got[-3:]).all()


CLOUDS = {
    "even": np.random.default_rng(2).integers(-3000, 3000, (4000, 2)),
    "clusters": np.concatenate([np.random.default_rng(3).normal(c, s, (900, 2)) for c, s in ((0, 30), (5000, 500), (100_000, 10))] + [np.random.default_rng(4).integers(-200_000, 200_000, (100, 2))]).astype(int),
    "grid": np.array([(i * 10, j * 10) for i in range(60) for j in range(60)]),
    "ring": np.rint(np.column_stack([50_000 * np.cos(np.arange(2000)), 50_000 * np.sin(np.arange(2000))])).astype(int),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_tiles_give_the_triangles_of_the_whole_cloud(spark, name):
    p = np.unique(CLOUDS[name], axis=0)
    want = canonical(p[delaunay(p[:, 0], p[:, 1])])
    df = spark.createDataFrame([(int(a), int(b), int(i)) for i, (a, b) in enumerate(p)] + [(None, 1, 1), (int(p[0, 0]), int(p[0, 1]), 10**6)], "xi int, yi int, zi int")
    rows = raw_triangles(df, 600).toPandas()
    got = canonical(rows[["x0", "y0", "x1", "y1", "x2", "y2"]].to_numpy())
    assert got == want and len(rows) == len(want)
    assert rows[["z0", "z1", "z2"]].to_numpy().max() < len(p)


def test_shade_of_a_plane_and_a_ridge(spark):
    """On a plane every normal is the same; on a ridge the shade is the middle of both sides' normals."""
    xy = np.array([(x, y) for x in range(0, 100, 5) for y in range(0, 100, 5)], float)
    plane = surface.tin(_points(spark, np.column_stack([xy, 0.5 * xy[:, 0]])))
    shade = surface.hillshade(plane, 5.0, (1.0, 0.0, 1.0)).toPandas()["value"].to_numpy()
    want = 255 * abs((-0.5 + 1) / math.sqrt(1.25) / math.sqrt(2))
    assert len(shade) == 19 * 19 and np.abs(shade - want).max() < 1e-6
    ridge = surface.tin(_points(spark, np.column_stack([xy, -np.abs(xy[:, 0] - 50)])))
    got = surface.hillshade(ridge, 5.0, (0.0, 0.0, 1.0)).toPandas().set_index(["col", "row"])["value"]
    assert got.loc[(2, 5)] == pytest.approx(255 / math.sqrt(2)) and got.loc[(10, 5)] > 255 / math.sqrt(2) + 20


def test_control_points(spark):
    """On a plane the marks' errors come out, and lowering by their mean takes the mean away; outside there is no height. On stairs the triangle's own height counts."""
    from pointlake.operators import matching

    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 100, (500, 2)).round(2)
    points = _points(spark, np.column_stack([xy, 0.2 * xy[:, 0] + 50]))
    marks = [(f"m{i}", float(x), float(y), 0.2 * float(x) + 50 - float(e)) for i, (x, y, e) in enumerate(zip(rng.uniform(20, 80, 20), rng.uniform(20, 80, 20), rng.uniform(0, 2, 20)))]
    df = spark.createDataFrame([*marks, ("far", 500.0, 500.0, 1.0)], "name string, x double, y double, z double")
    control = matching.control_on_surface(points, df)
    got = {r.name: r.dz for r in control.collect()}
    assert got.pop("far") is None and all(got[n] == pytest.approx(0.2 * x + 50 - z, abs=0.01) for n, x, _, z in marks)
    lower = matching.control_on_surface(matching.adjust_z(points, control), df)
    assert abs(lower.selectExpr("avg(dz)").first()[0]) < 0.01
    steps = np.array([(x, y) for x in range(0, 50, 10) for y in range(0, 50, 10)], float)
    stairs = _points(spark, np.column_stack([steps, np.floor(steps[:, 0] / 20) * 5]))
    places = spark.createDataFrame([("tread", 5.0, 23.0, 0.0), ("riser", 15.0, 23.0, 0.0), ("corner", 20.0, 20.0, 0.0)], "name string, x double, y double, z double")
    assert {r.name: r.surface for r in matching.control_on_surface(stairs, places).collect()} == pytest.approx({"tread": 0.0, "riser": 2.5, "corner": 5.0})


def test_heights_with_triangles_of_all_sizes(spark):
    """A dense cluster, thin triangles across the whole cloud, and places outside, without coordinates and at corners: on a plane each has its height, from one cell for all but an uneven cloud."""
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 4, (900, 2)), rng.uniform(0, 900, (300, 2)), [(-1000, -1000), (3000, -1010), (3000, 3000), (-1000, 2990)]]).round(2)
    tri = surface.tin(_points(spark, np.column_stack([xy, 0.5 * xy[:, 0] + 700])))
    at = np.concatenate([xy[:50], rng.uniform(0, 4, (100, 2)), rng.uniform(-900, 2900, (300, 2)), [(3000, 0), (5000, 0), (-2000, 100)]])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(10**6, None, 1.0)]
    places = spark.createDataFrame(rows, "k long, x double, y double")
    got = {r.k: r.surface for r in surface.heights_at(tri, places, ["k"], outside=True).collect()}
    known = {r.k: r.surface for r in surface.heights_at(tri, places, ["k"]).collect()}
    assert len(got) == len(rows) and {k for k, v in got.items() if v is None} == {len(at) - 1, len(at) - 2, 10**6}
    assert known == {k: v for k, v in got.items() if v is not None}
    assert all(abs(v - (0.5 * at[k][0] + 700)) < 0.02 for k, v in known.items())
    assert surface._levels({k: 10**k for k in range(6)}) == [5] and surface._levels({}) == [0]
    assert surface._levels({0: 500, 9: 500, 20: 3}) == [0, 3, 6, 9]


def test_cells_on_edges_come_once(spark):
    """Centres at corners, on edges, on the hull and within triangles: each cell once, and only those on edges are shuffled."""
    xy = np.array([(x, y) for x in range(0, 60, 5) for y in range(0, 60, 5)] + [(x + 2.13, y + 1.77) for x in range(0, 50, 10) for y in range(0, 50, 10)], float)
    raster = surface.dem(surface.tin(_points(spark, np.column_stack([xy, 2 * xy[:, 0] - xy[:, 1] + 100]))), 1.0 / 2, 1e9)
    got = raster.toPandas()
    assert not got.duplicated(["col", "row"]).any() and len(got) == 110 * 110
    assert np.allclose(got["value"], got["col"] + 0.5 - got["row"] / 2 - 0.25 + 100, atol=0.02)
    coarse = surface.dem(surface.tin(_points(spark, np.column_stack([xy, xy[:, 0]]))), 2.0, 1e9).toPandas()  # centres on the lines x = 5, 15 ...
    assert not coarse.duplicated(["col", "row"]).any() and len(coarse) == 27 * 27 + 2 * 27 + 1
    assert "Union" in raster._jdf.queryExecution().optimizedPlan().toString()
