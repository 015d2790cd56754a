"""Forward values against the worked examples of J. P. Snyder, Map Projections: A Working Manual (1987)."""

import pytest
from pyspark.sql import functions as F

from pointlake.functions import projections as proj

CLARKE = proj.ELLIPSOIDS["clarke1866"]


def value(spark, pair):
    return tuple(spark.range(1).select(*pair).first())


def test_worked_examples(spark):
    at = F.lit(-73.5), F.lit(40.5)
    x, y = value(spark, proj.transverse_mercator(*at, -75.0, 0.9996, 0.0, e=CLARKE))
    assert x == pytest.approx(127106.5, abs=0.1) and y == pytest.approx(4484124.4, abs=0.1)
    at = F.lit(-75.0), F.lit(35.0)
    x, y = value(spark, proj.lambert_conic(*at, -96.0, 23.0, 33.0, 45.0, e=CLARKE))
    assert x == pytest.approx(1894410.9, abs=0.1) and y == pytest.approx(1564649.5, abs=0.1)
    x, y = value(spark, proj.albers(*at, -96.0, 23.0, 29.5, 45.5, e=CLARKE))
    assert x == pytest.approx(1885472.7, abs=0.1) and y == pytest.approx(1535925.0, abs=0.1)


def test_zone_32_on_its_meridian(spark):
    x, y = value(spark, proj.utm(F.lit(9.0), F.lit(45.0), 32))
    assert x == pytest.approx(500000.0, abs=1e-6) and y == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_far_from_the_centre_and_beyond_a_pole(spark):
    """Round trips at any longitude, next to a pole, and with latitudes of more than 90 degrees, of which the sine counts."""
    from pointlake.functions import reference_systems as rs

    rows = [(8.0 + 40.0 * i, 45.0 + d) for i in range(31) for d in (0.01, 20.0, 44.9999, 45.00001, 60.0)]
    at = spark.createDataFrame(rows, "lon double, lat double")
    cone = (9.0, 45.0, 44.0, 49.0)
    for there, back in (
        (lambda a, b: proj.lambert_conic(a, b, *cone), lambda x, y: proj.inverse_lambert_conic(x, y, *cone)),
        (lambda a, b: proj.utm(a, b, 32), lambda x, y: proj.inverse_utm(x, y, 32)),
        (lambda a, b: rs.from_epsg(3005).from_lonlat(a, b, F.lit(0.0))[:2], lambda x, y: rs.from_epsg(3005).to_lonlat(x, y, F.lit(0.0))[:2]),
        (lambda a, b: rs.from_epsg(28992).from_lonlat(a, b, F.lit(0.0))[:2], lambda x, y: rs.from_epsg(28992).to_lonlat(x, y, F.lit(0.0))[:2]),
    ):
        x, y = there(F.col("lon"), F.col("lat"))
        lon, lat = back(F.col("x"), F.col("y"))
        got = at.withColumns({"x": x, "y": y}).select("lon", "lat", proj.apart(F.col("lon"), F.col("lat"), lon, lat).alias("apart")).collect()
        assert [r for r in got if not r.apart < 1e-8] == []
