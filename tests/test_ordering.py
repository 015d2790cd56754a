"""Blocks of a file's points against plain windows and plain Python."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointlake.functions import ordering
from pointlake.operators.flightlines import recover_flightlines


def test_blocks_as_windows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 8)
    rng = random.Random(3)
    rows = [(f, i, rng.choice([None, 0, 1])) for f in ("a", "b", None) for i in sorted(rng.sample(range(90), 50))]
    df = spark.createDataFrame([*rows, ("a", None, 1), ("c", None, 0)], "source_file string, point_index long, v int")
    order = Window.partitionBy("source_file").orderBy("point_index")
    got = ordering.with_previous(ordering.running_sum(df, F.lit(1), "k"), "v", "p")
    want = df.withColumns({"k": F.row_number().over(order).cast("long"), "p": F.lag("v").over(order)})
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordering.running_sum(df.limit(0), F.lit(1), "k").count() == 0


def test_flight_lines_by_spans(spark):
    rng = random.Random(5)
    times = [round(rng.uniform(0, 60), 2) for _ in range(200)] + [7.0, 7.0, None, -3.5, 1000.0]
    rows = [(f, k, t) for f in ("a", None) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "source_file string, point_index long, gps_time double")
    for gap in (0.0, 0.1, 0.5, 2.0, 5000.0):
        line, last, want = 0, None, []
        for t in sorted(t for t in times if t is not None):
            line += last is not None and t - last > gap
            want.append((t, line))
            last = t
        got = recover_flightlines(df.withColumn("line", F.lit("old")), gap)
        assert got.columns == ["source_file", "point_index", "gps_time", "line"]
        for f in ("a", None):
            assert sorted((r.gps_time, r.line) for r in got.where(F.col("source_file").eqNullSafe(F.lit(f))).collect()) == want
