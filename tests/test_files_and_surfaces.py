"""LAS files written and read, surfaces against brute force, points in many polygons, whole streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.operators import spatial, surface
from pointlake.plans import catalogue
from pointlake.plans.options import run_options
from pointlake.schema import lineitem_points
from pointlake.sources import las
from pointlake.sources.las import LasWriter, _Written

FIELDS = ["xi", "yi", "zi", "intensity", "return_number", "classification", "user_data", "point_source_id", "green"]


def test_las_round_trip_and_box(spark, sf_dir, tmp_path):
    las.register(spark)
    points = lineitem_points(spark, sf_dir)
    low, high = points.where("xi < 10000"), points.where("xi >= 10000")
    for name, part in (("low", low), ("high", high)):
        part.repartition(2).write.format("las").mode("append").save(f"{tmp_path}/{name}")
    got = spark.read.format("las").load(str(tmp_path))
    assert sorted(map(tuple, got.select(*FIELDS).collect())) == sorted(map(tuple, points.select(*FIELDS).collect()))
    assert got.where(F.col("x") != F.col("xi") * 0.01).count() == 0
    files = got.select("source_file").distinct().count()
    some = spark.read.format("las").option("inside", "0,0,50,1000000").load(str(tmp_path))
    assert some.select("source_file").distinct().count() < files and some.where("xi <= 5000").count() == points.where("xi <= 5000").count()
    assert not list(tmp_path.rglob("*.waiting"))
    one = sorted(tmp_path.rglob("*.las"))[0]
    (tmp_path / "list.txt").write_text(f"{one.relative_to(tmp_path)}\n{one}\n")
    listed = spark.read.format("las").option("listed", f"{tmp_path}/list.txt").load(str(tmp_path)).select("source_file").distinct().collect()
    assert [r.source_file for r in listed] == [str(one)]


def test_las_abort_leaves_nothing(tmp_path):
    (tmp_path / "_a.waiting").write_bytes(b"x")
    LasWriter({"path": str(tmp_path)}).abort([_Written([(f"{tmp_path}/_a.waiting", f"{tmp_path}/part-a.las")]), None, _Written()])
    assert list(tmp_path.iterdir()) == []


def _points(spark, xyz, classes=None):
    rows = [("f", i, *(round(float(v) * 100) for v in p), int(c)) for i, (p, c) in enumerate(zip(xyz, classes if classes is not None else [2] * len(xyz), strict=True))]
    return spark.createDataFrame(rows, "source_file string, point_index long, xi int, yi int, zi int, classification int")


def test_triangles_are_delaunay_and_cover_the_hull(spark):
    rng = np.random.default_rng(5)
    xyz = np.column_stack([rng.uniform(0, 90, (400, 2)).round(2), rng.uniform(0, 20, 400).round(2)])
    xyz = np.vstack([xyz, xyz[:20] + [0, 0, 5]])  # places that repeat: the lowest counts
    t = surface.tin(_points(spark, xyz)).toPandas()
    c = t[surface.CORNERS].to_numpy().reshape(-1, 3, 3)
    u, v = c[:, 1, :2] - c[:, 0, :2], c[:, 2, :2] - c[:, 0, :2]
    area = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2
    hull = surface._hull(xyz[:, :2])
    x, y = hull[:, 0], hull[:, 1]
    assert area.sum() == pytest.approx(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2, rel=1e-3)
    places = {tuple(p[:2]): p[2] for p in xyz[::-1].round(2)}
    for corner in c[:, :, :].reshape(-1, 3):
        assert corner[2] == pytest.approx(min(z for z in xyz[(np.abs(xyz[:, :2] - corner[:2]) < 1e-6).all(1), 2]))
    p = np.array(sorted(places))
    for a, b, d in c[:, :, :2]:
        m = 2 * np.array([b - a, d - a])
        centre = np.linalg.solve(m, [(b @ b) - (a @ a), (d @ d) - (a @ a)])
        r = np.linalg.norm(a - centre)
        assert (np.linalg.norm(p - centre, axis=1) > r * (1 - 1e-6)).all()


def test_raster_and_heights_of_a_plane(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 200, (600, 2)).round(2)
    plane = lambda q: 0.3 * q[:, 0] - 0.2 * q[:, 1] + 40
    above = rng.uniform(40, 160, (50, 2)).round(2)
    xyz = np.vstack([np.column_stack([xy, plane(xy)]), np.column_stack([above, plane(above) + 7])])
    points = _points(spark, xyz, [2] * 600 + [1] * 50)
    cells = surface.dem(surface.tin(points.where("classification = 2")), 5.0).toPandas()
    want = plane((cells[["col", "row"]].to_numpy() + 0.5) * 5.0)
    assert len(cells) > 1200 and np.abs(cells["value"] - want).max() < 0.05
    heights = surface.height_above_ground(points).toPandas().set_index("point_index")["height"].sort_index()
    assert len(heights) == 650 and np.abs(heights.loc[600:] - 7).max() < 0.05 and heights.loc[:599].abs().max() < 1e-9


@pytest.mark.parametrize(("most", "least"), [(60_000, 0.97), (2_500, 0.95)])
def test_ground_is_told_from_what_stands_on_it(spark, most, least):
    """In one tile, and in sixteen."""
    rng = np.random.default_rng(7)
    xy = rng.uniform(0, 400, (3600, 2))
    tree = rng.uniform(20, 380, (800, 2))
    xyz = np.vstack([np.column_stack([xy, 0.05 * xy[:, 0]]), np.column_stack([tree, 0.05 * tree[:, 0] + rng.uniform(5, 20, 800)])])
    got = surface.classify_ground(_points(spark, xyz, [1] * 4400), 20.0, 1.0, most=most).toPandas().set_index("point_index")["is_ground"].sort_index()
    assert len(got) == 4400 and got.loc[:3599].mean() > least and got.loc[3600:].mean() < 0.01


def test_equal_points_in_polygons_stay(spark):
    points = spark.createDataFrame([(500, 500), (500, 500), (5000, 5000)], "xi int, yi int")
    edges = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("a", 10.0, 0.0, 10.0, 10.0), ("a", 10.0, 10.0, 0.0, 10.0), ("a", 0.0, 10.0, 0.0, 0.0)], "name string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in spatial.clip_many(points, edges, 5.0).collect()] == [(500, 500, "a")] * 2


def test_other_spellings(spark, sf_dir):
    points = lineitem_points(spark, sf_dir)
    got = run_options(points, "-set_extended_overlap_flag 1 -set_extended_scanner_channel 2 -change_extended_classification_from_to 2 9")
    assert {(r.overlap_flag, r.scanner_channel) for r in got.select("overlap_flag", "scanner_channel").distinct().collect()} == {(1, 2)}
    assert run_options(points, "-scale_rgb 2 1 1").columns == points.columns


def test_streams_give_whole_results(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in ("stream_thin_time", "stream_sessions", "stream_counts"):
        assert catalogue.QUERIES[name](spark, sf_dir).agg(F.sum("n")).first()[0] == events
