"""The index and the canopy models on a planted scene."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pointlake.operators import workflows
from pointlake.operators.aggregates import precision
from pointlake.operators.index import Quadtree, coarsen
from tests.test_files_and_surfaces import _points


def test_quadtree(spark):
    tree = Quadtree.around(3.0, -5.0, 90.0, 40.0, 10.0)
    assert tree.levels == 4 and tree.min_x <= 3.0 and tree.min_y <= -5.0
    assert tree.min_x + 160 > 90 and (0.0 - tree.min_x) / 10 == 3  # 10 columns of 16: three more below, three above
    rng = np.random.default_rng(1)
    xyz = np.column_stack([rng.uniform(3, 90, 300), rng.uniform(-5, 40, 300), np.zeros(300)]).round(2)
    got = tree.indexed(_points(spark, xyz)).withColumns(tree.box(F.col("cell_code"))).withColumn("up", coarsen(F.col("cell_code")))
    wide = got.withColumns({f"wide_{k}": v for k, v in tree.box(F.col("up"), 3).items()}).toPandas()
    x, y = wide["xi"] / 100, wide["yi"] / 100
    for p, size in (("", 10.0), ("wide_", 20.0)):
        assert ((x >= wide[f"{p}cell_min_x"]) & (x < wide[f"{p}cell_max_x"]) & (y >= wide[f"{p}cell_min_y"]) & (y < wide[f"{p}cell_max_y"])).all()
        assert (wide[f"{p}cell_max_x"] - wide[f"{p}cell_min_x"] == size).all()
    assert tree.rectangle(spark, 500.0, 500.0, 600.0, 600.0).count() == 0
    assert tree.rectangle(spark, 40.0, 10.0, 60.0, 30.0).count() == tree.circle(spark, 50.0, 20.0, 10.0).count() == 4  # upper edges are left out
    assert (tree.rectangle(spark, 36.0, 6.0, 64.0, 34.0).count(), tree.circle(spark, 50.0, 20.0, 14.0).count()) == (16, 12)


def test_canopy_models(spark):
    rng = np.random.default_rng(2)
    ground = np.column_stack([rng.uniform(0, 100, (800, 2)), np.zeros(800)])
    crown = np.column_stack([rng.uniform(40, 60, (400, 2)), np.full(400, 12.0)])
    pits = np.column_stack([rng.uniform(44, 56, (15, 2)), np.full(15, 1.0)])
    points = _points(spark, np.vstack([ground, crown, pits]), [2] * 800 + [1] * 415).withColumn("return_number", F.lit(1))
    tall = workflows.normalize(points)
    assert tall.count() > 1150
    inside = (F.col("col").between(45, 54)) & (F.col("row").between(45, 54))
    plain = workflows.canopy_model(tall, 1.0, 0.5, 50.0).where(inside).agg(F.min("value")).first()[0]
    free = workflows.pit_free_canopy_model(tall, 1.0, 0.5, (0.0, 2.0, 5.0), 10.0).where(inside).agg(F.min("value")).first()[0]
    assert plain < 9 and abs(free - 12) < 0.1  # pits and ground below the crown are gone
    terrain = workflows.terrain_model(points, 5.0).toPandas()
    assert len(terrain) > 300 and terrain["value"].abs().max() < 1e-9
    again = workflows.with_ground(points.withColumn("classification", F.lit(1)), 30.0, 0.5).toPandas().set_index("point_index")["classification"].sort_index()
    assert (again.loc[800:1199] == 1).all() and (again.loc[:799] == 2).mean() > 0.9


def test_precision_of_far_values(spark):
    """Differences across ranges of every level, ends of 32 bits and nulls."""
    values = [-(2**31), -(2**31), -(2**22) - 1, -1, 0, 0, 0, 4095, 4096, 2**22, 2**31 - 1, None]
    df = spark.createDataFrame([(v,) for v in values], "xi int")
    placed = sorted(v for v in values if v is not None)
    want = Counter(b - a for a, b in zip(placed, placed[1:], strict=False))
    assert {r["diff"]: r.n for r in precision(df).collect()} == want
    far = df.where("xi IN (-2147483648, 2147483647)").distinct()
    assert [(r["diff"], r.n) for r in precision(far).collect()] == [(None, 1)]
    assert precision(df.where("xi IS NULL")).collect() == [] and precision(df.limit(0)).collect() == []
