"""Reference systems: published worked examples to the millimetre, and the same system in every spelling."""

import struct

import pytest
from pyspark.sql import functions as F

from pointlake.functions import reference_systems as rs
from pointlake.functions.projections import ELLIPSOIDS, Ellipsoid
from pointlake.schema import ScaleOffset

dms = lambda d, m=0, s=0.0: (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)
US_FOOT = 1200 / 3937

#: Published worked examples (system, longitude, latitude, easting, northing).
EXAMPLES = {
    "british grid": (rs.from_epsg(27700), 0.5, 50.5, 577274.99, 69740.50, 0.01),
    "texas, feet": (rs._system("lcc", ELLIPSOIDS["clarke1866"], US_FOOT, -99.0, dms(27, 50), dms(28, 23), dms(30, 17), 1.0, 2_000_000 * US_FOOT, 0.0), -96.0, 28.5, 2963503.91, 254759.80, 0.01),
    "netherlands": (rs.from_epsg(28992), 6.0, 53.0, 196105.283, 557057.739, 0.001),
    "borneo, at the centre": (rs._system("homc", ELLIPSOIDS["everest1967"], 1.0, 115.0, 4.0, None, None, 0.99984, 590476.87, 442857.65, dms(53, 18, 56.9537), dms(53, 7, 48.3685)), dms(115, 48, 19.8196), dms(5, 23, 14.1129), 679245.73, 596562.78, 0.01),
    "borneo, natural origin": (rs._system("hom", ELLIPSOIDS["everest1967"], 1.0, 115.0, 4.0, None, None, 0.99984, 0.0, 0.0, dms(53, 18, 56.9537), dms(53, 7, 48.3685)), dms(115, 48, 19.8196), dms(5, 23, 14.1129), 679245.73, 596562.78, 1.0),
    "albers": (rs._system("aeac", Ellipsoid(6378206.4, 294.978698), 1.0, -96.0, 23.0, 29.5, 45.5, 1.0, 0.0, 0.0), -75.0, 35.0, 1885472.7, 1535925.0, 0.1),
    "swiss": (rs.from_epsg(2056), 7.439583333333333, 46.95240555555556, 2_600_000.0, 1_200_000.0, 0.001),
}


@pytest.mark.parametrize("name", EXAMPLES)
def test_worked_examples_and_back(spark, name):
    system, lon, lat, east, north, near = EXAMPLES[name]
    row = spark.createDataFrame([(lon, lat, 12.5)], "lon double, lat double, h double")
    there = row.select("*", *[c.alias(n) for c, n in zip(system.from_lonlat(F.col("lon"), F.col("lat"), F.col("h")), "xyz")])
    back = there.select("x", "y", "z", *[c.alias(n) for c, n in zip(system.to_lonlat(F.col("x"), F.col("y"), F.col("z")), ("lon", "lat", "h"))]).first()
    assert (back.x, back.y, back.z) == pytest.approx((east, north, 12.5), abs=near)
    assert (back.lon, back.lat, back.h) == pytest.approx((lon, lat, 12.5), abs=1e-9)


def keys(*entries, doubles=()):
    flat = [1, 1, 0, len(entries)] + [v for e in entries for v in e]
    return struct.pack(f"<{len(flat)}H", *flat), struct.pack(f"<{len(doubles)}d", *doubles)


WKT = """PROJCS["ETRS89 / UTM zone 32N", GEOGCS["ETRS89", DATUM["European_Terrestrial_Reference_System_1989", SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]]],
  PRIMEM["Greenwich",0], UNIT["degree",0.0174532925199433]], PROJECTION["Transverse_Mercator"], PARAMETER["latitude_of_origin",0], PARAMETER["central_meridian",9],
  PARAMETER["scale_factor",0.9996], PARAMETER["false_easting",500000], PARAMETER["false_northing",0], UNIT["metre",1]]"""


def test_spellings_of_one_zone():
    one = rs.from_epsg(25832)
    assert rs.from_wkt(WKT) == rs.from_wkt(f'COMPD_CS["both",{WKT},VERT_CS["height",VERT_DATUM["any",2005],UNIT["metre",1]]]') == one
    assert rs.from_proj("+proj=utm +zone=32 +ellps=GRS80 +units=m +no_defs") == rs.from_proj("+proj=tmerc +lat_0=0 +lon_0=9 +k=0.9996 +x_0=500000 +y_0=0 +ellps=GRS80") == one
    assert rs.from_geokeys(*keys((1024, 0, 1, 1), (3072, 0, 1, 25832))) == one
    made = keys((1024, 0, 1, 1), (3072, 0, 1, 32767), (2048, 0, 1, 4258), (3075, 0, 1, 1), (3080, 34736, 1, 0), (3081, 34736, 1, 1), (3092, 34736, 1, 2), (3082, 34736, 1, 3), doubles=(9.0, 0.0, 0.9996, 500000.0))
    assert rs.from_geokeys(*made) == one
    assert rs.from_options("-etrs89 -utm 32T") == rs.from_options("-epsg 25832") == rs.from_options("-grs80 -tm 500000 0 meter 0 9 0.9996") == one
    assert rs.of_header([("LASF_Projection", 34735, keys((1024, 0, 1, 1), (3072, 0, 1, 25832))[0])]) == rs.of_header([("LASF_Projection", 2112, WKT.encode() + b"\0")]) == one
    assert rs.of_header([("other", 34735, b"")]) is None


def test_feet_geographic_and_unknown():
    feet = rs.from_wkt(WKT.replace('UNIT["metre",1]', f'UNIT["US survey foot",{US_FOOT}]').replace("500000", "1640416.6666666667"))
    assert feet.unit == US_FOOT and feet.shift[0] == pytest.approx(500000.0)
    assert rs.from_proj("+proj=longlat +datum=NAD27").ellipsoid == ELLIPSOIDS["clarke1866"] and rs.from_epsg(4978).kind == "ecef"
    assert rs.from_options("-utm 55south") == rs.from_epsg(32755) == rs.from_options("-utm 55H")
    lcc = rs.from_options("-nad27 -lcc 2000000 0 survey_feet 27.5 -99 28 30")
    assert lcc.parameters == (-99.0, 27.5, 28.0, 30.0) and lcc.shift[0] == pytest.approx(2_000_000 * US_FOOT)
    for bad in (lambda: rs.from_epsg(1), lambda: rs.from_wkt("nothing"), lambda: rs.from_options("-what"), lambda: rs.utm(61), lambda: rs.from_wkt(WKT.replace("Transverse_Mercator", "Gall"))):
        with pytest.raises(ValueError):
            bad()


def test_reproject_points(spark):
    """From one zone to the next and back is where it was, to the nearest step; degrees keep seven digits."""
    points = spark.createDataFrame([(50_000_000 + 1234 * i, 550_000_000 - 77 * i, 100 * i) for i in range(50)], "xi int, yi int, zi int")
    a, b = rs.from_epsg(32632), rs.from_epsg(32633)
    back = rs.reproject(rs.reproject(points, a, b), b, a)
    assert all(abs(r.xi - s.xi) <= 1 and abs(r.yi - s.yi) <= 1 and r.zi == s.zi for r, s in zip(sorted(back.select("xi", "yi", "zi").collect()), sorted(points.collect()), strict=True))
    degrees = rs.reproject(points, a, rs.from_epsg(4326))
    again = rs.reproject(degrees, rs.from_epsg(4326), a, scaling=ScaleOffset((1e-7, 1e-7, 0.01)))
    assert degrees.first().xi > 89_000_000 and all(abs(r.xi - s.xi) <= 2 for r, s in zip(sorted(again.select("xi", "yi").collect()), sorted(points.collect()), strict=True))
