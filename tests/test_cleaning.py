"""Neighbourhoods and connected cells against plain searches; components of graphs of several shapes; text sources and mapped values."""

import gzip
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions.components import components
from pointlake.operators import cleaning, flightlines, matching
from pointlake.operators.transforms import TRANSFORMS
from pointlake.sources import grids, text


def cloud(spark, xyz, **more):
    rows = [("f", i, *(int(v) for v in p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "source_file string, point_index long, xi int, yi int, zi int")


def flood(cells):
    label, left = {}, set(cells)
    while left:
        todo = [left.pop()]
        part = []
        while todo:
            c = todo.pop()
            part.append(c)
            for d in np.ndindex(3, 3, 3):
                n = tuple(int(a + b - 1) for a, b in zip(c, d))
                if n in left:
                    left.remove(n)
                    todo.append(n)
        label |= dict.fromkeys(part, min(part))
    return label


@pytest.mark.parametrize("block", [64, 3])
def test_neighbourhoods(spark, monkeypatch, block):
    monkeypatch.setattr(cleaning, "_BLOCK", block)
    rng = np.random.default_rng(0)
    xyz = np.concatenate([rng.integers(-3000, 3000, (400, 3)), rng.integers(-300, 300, (300, 3)), np.zeros((5, 3), int)])
    points = cloud(spark, xyz)
    cell = np.floor(xyz * 0.01 / 2.0).astype(int)
    count = Counter(map(tuple, cell.tolist()))
    around = lambda c: sum(count.get(tuple(a + b - 1 for a, b in zip(c, d)), 0) for d in np.ndindex(3, 3, 3))
    noise = {r.point_index for r in cleaning.mark_noise(points, 2.0, 4).where("is_noise").collect()}
    assert noise == {i for i, c in enumerate(cell.tolist()) if around(c) <= 4}
    near = np.where(xyz >= 0, np.floor(xyz * 0.01 / 2.0 + 0.5), np.ceil(xyz * 0.01 / 2.0 - 0.5)).astype(int)
    kept = {r.point_index for r in cleaning.drop_nearby(points, 2.0).collect()}
    assert kept == {i for i in range(len(near)) if not (np.abs(near[:i] - near[i]).max(1) <= 1).any()}

    want = flood(set(map(tuple, cell.tolist())))
    got = {(r.qx, r.qy, r.qz): r.component for r in cleaning.connected_cells(points, 2.0, 2.0).collect()}
    assert set(got) == set(want)
    assert len({(got[c], want[c]) for c in want}) == len(set(want.values())) == len(set(got.values()))
    sizes = Counter(want[tuple(c)] for c in cell.tolist())
    marked = {r.point_index for r in cleaning.mark_unconnected(points, 2.0, 2.0, 20).where("is_noise").collect()}
    assert marked == {i for i, c in enumerate(cell.tolist()) if sizes[want[tuple(c)]] < 20} and 0 < len(marked) < len(xyz)
    assert cleaning.connected_cells(points.limit(0), 2.0, 2.0).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(50)]
    ring = [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    edges = spark.createDataFrame(chain + star + ring + [(5, 5), (1, 0), (9000, 9000)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1051), 1000), **dict.fromkeys(range(2000, 2030), 2000)}
    assert components(edges.limit(0)).count() == 0


def test_points_without_a_time_stay(spark):
    rows = [("f", i, 0, 0, 100 * i, t, r, 9) for i, (t, r) in enumerate([(1.0, 1), (1.0, 2), (None, 1), (None, 3), (2.0, 1)])]
    points = spark.createDataFrame(rows, "source_file string, point_index long, xi int, yi int, zi int, gps_time double, return_number int, number_of_returns int")
    fixed = {r.point_index: r.number_of_returns for r in flightlines.repair_number_of_returns(points).collect()}
    assert fixed == {0: 2, 1: 2, 2: 9, 3: 9, 4: 1}
    rail = spark.createDataFrame([("f", 0.0, 10.0), ("f", 4.0, 50.0)], "source_file string, gps_time double, z double")
    heights = {r.point_index: r.track_z for r in matching.track(points, rail).collect()}
    assert heights == {0: 20.0, 1: 20.0, 2: None, 3: None, 4: 30.0}


def test_map_files(spark, tmp_path):
    """Of two lines for a value the first counts; comments and values that don't fit are left out."""
    (tmp_path / "map.txt").write_text("# from to\n 4 40\n7 70\n4 44\n70000 1\nx y\n9\n5 50 rest\n")
    points = spark.createDataFrame([(v,) for v in (4, 5, 7, 9, 70000)], "intensity int")
    got = sorted(r.intensity for r in TRANSFORMS["map_intensity"](points, str(tmp_path / "map.txt")).collect())
    assert got == [9, 40, 50, 70, 70000]


def test_text_sources(spark, tmp_path):
    lines = ["1.25 2.5 -3.75 200", "10 20 30 7", "not a point"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("5 6 7 8\n")
    got = text.read_text(spark, str(tmp_path), "xyzi")
    assert sorted((r.xi, r.yi, r.zi, r.intensity) for r in got.collect()) == [(125, 250, -375, 200), (500, 600, 700, 8), (1000, 2000, 3000, 7)]
    assert got.select(F.element_at(F.split("source_file", "/"), -1).alias("n")).distinct().count() == 2
    (tmp_path / "c.pts").write_text("2\n1 2 3 -2048\n4 5 6 2047\n")
    assert sorted((r.xi, r.intensity) for r in text.read_pts(spark, str(tmp_path / "c.pts")).collect()) == [(100, 0), (400, 4095)]
    (tmp_path / "d.asc").write_text("ncols 3\nnrows 2\nxllcorner 100\nyllcorner 50\ncellsize 10\nNODATA_value -9999\n1 -9999 3\n4 5 6\n")
    cells = sorted(tuple(r) for r in grids.read_asc(spark, str(tmp_path / "d.asc")).collect())
    assert cells == [(0, 0, 105.0, 55.0, 4.0), (0, 1, 105.0, 65.0, 1.0), (1, 0, 115.0, 55.0, 5.0), (2, 0, 125.0, 55.0, 6.0), (2, 1, 125.0, 65.0, 3.0)]
    (tmp_path / "e.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nend_header\n1 2 3\n-4.5 5e1 6\n3 0 1 1\n")
    assert sorted(tuple(r) for r in grids.read_ply_text(spark, str(tmp_path / "e.ply")).collect()) == [(-4.5, 50.0, 6.0), (1.0, 2.0, 3.0)]
