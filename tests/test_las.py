"""The LAS source: scalings, formats, overwriting, bounds and indexes, against plain readings of the bytes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.operators.filters import keep_xy
from pointlake.operators.ordered import thin_with_grid
from pointlake.operators.spatial import sort_spatially
from pointlake.schema import lineitem_points
from pointlake.sources import las


def save(df, path, mode="append", **options):
    las.register(df.sparkSession)
    df.coalesce(1).write.format("las").options(**options).mode(mode).save(str(path))


def load(spark, path, **options):
    return spark.read.format("las").options(**options).load(str(path))


def test_a_file_of_another_scale(spark, tmp_path):
    """100 points in a square of 100 by 100 by their own coordinates are all in that square for the operators."""
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 100_000, (100, 3))]
    fine = {"inScale": "0.001,0.001,0.001", "inOffset": "500,-500,0", "scale": "0.001,0.001,0.001", "offset": "500,-500,0"}
    save(spark.createDataFrame(rows, "xi int, yi int, zi int"), tmp_path, **fine)
    got = load(spark, tmp_path, scaling="true")
    assert got.where(keep_xy(500.0, -500.0, 600.01, -399.99)).count() == 100
    want = sorted((x * 0.001 + 500, y * 0.001 - 500) for x, y, _ in rows)
    assert np.allclose(sorted((r.x, r.y) for r in got.collect()), want)
    first = got.first()
    assert (first.scale_x, first.offset_x, first.offset_y) == (0.001, 500.0, -500.0)
    half = [(5, -5, 0), (4, -4, 0), (15, -15, 0)]  # halves go away from zero
    save(spark.createDataFrame(half, "xi int, yi int, zi int"), tmp_path / "half", inScale="0.001,0.001,0.001", scale="0.001,0.001,0.001")
    assert [(r.xi, r.yi) for r in load(spark, tmp_path / "half").collect()] == [(1, -1), (0, 0), (2, -2)]


def test_mixed_folder_thins_as_one_cloud(spark, sf_dir, tmp_path):
    points = lineitem_points(spark, sf_dir).withColumn("source_file", F.lit("f"))
    save(points.where("xi % 2 = 0"), tmp_path / "a", scale="0.001,0.001,0.001", offset="10,20,30")
    save(points.where("xi % 2 = 1"), tmp_path / "b", offset="-1000,5,0")
    both = load(spark, tmp_path).withColumn("source_file", F.lit("f"))
    assert sorted(map(tuple, both.select("xi", "yi", "zi").collect())) == sorted(map(tuple, points.select("xi", "yi", "zi").collect()))
    cells = lambda df: df.select(F.floor(F.col("xi") / 1000), F.floor(F.col("yi") / 1000)).distinct().count()
    assert thin_with_grid(both, 10.0).count() == cells(points)


def test_overwrite_and_append(spark, tmp_path):
    ten = spark.range(10).select(F.col("id").cast("int").alias("xi"))
    for mode, n in (("overwrite", 10), ("overwrite", 10), ("append", 20), ("overwrite", 10)):
        save(ten, tmp_path, mode)
        assert load(spark, tmp_path).count() == n
    save(spark.range(25).select(F.col("id").cast("int").alias("xi")), tmp_path, "overwrite", recordsPerFile="10")
    assert sorted(r.points for r in spark.read.format("las_headers").load(str(tmp_path)).collect()) == [5, 10, 10]
    with pytest.raises(Exception, match="32 bits"):
        save(ten, tmp_path / "far", offset="9000000,0,0", scale="0.001,0.01,0.01")


FIELDS = "xi int, yi int, zi int, ext_return_number int, ext_number_of_returns int, ext_classification int, scan_angle double, scanner_channel int, overlap_flag int, withheld_flag int, edge_of_flight_line int, nir int, gps_time double, attr_0 double"
ROWS = [(1, 2, 3, 9, 12, 200, 31.2, 3, 1, 1, 0, 65535, 0.5, 1.25), (4, 5, 6, 12, 12, 6, -90.0, 0, 0, 0, 1, 7, 1e9, -2.0), (7, 8, 9, 1, 1, 31, 0.006, 1, 0, 1, 1, 0, 0.0, 0.0)]


@pytest.mark.parametrize("options", [{"pointFormat": "8"}, {"pointFormat": "8", "compatible": "true"}, {"pointFormat": "10"}, {"pointFormat": "10", "compatible": "true"}])
def test_extended_fields_in_both_forms(spark, tmp_path, options):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    save(spark.createDataFrame(ROWS, FIELDS), tmp_path, extra="attr_0=height", **options)
    got = load(spark, tmp_path).select(*names, "return_number", "number_of_returns", "classification", "scan_angle_rank").orderBy("xi").collect()
    for r, want in zip(got, ROWS, strict=True):
        assert tuple(r)[:14] == pytest.approx(want, abs=1e-9)
    assert [tuple(r)[14:] for r in got] == [(6, 7, 0, 31), (7, 7, 6, -90), (1, 1, 31, 0)]
    head = spark.read.format("las_headers").load(str(tmp_path)).first()
    assert head.attributes[-1] == "height" and head.version == ("1.4" if "compatible" not in options else "1.3" if options["pointFormat"] == "10" else "1.2")
    # and back: what was read is written in the other form and gives the same again
    other = {"pointFormat": options["pointFormat"]} | ({} if "compatible" in options else {"compatible": "true"})
    save(load(spark, tmp_path), tmp_path / "other", extra="attr_0=height", **other)
    again = load(spark, tmp_path / "other").select(*names).orderBy("xi").collect()
    assert [tuple(r) for r in again] == [tuple(r)[:14] for r in got]


def test_added_attributes(spark, tmp_path):
    """Written as scaled integers, read as what they stand for; nulls by a no-data value."""
    df = spark.createDataFrame([(1, 12.34, -5.0, None, 7.5), (2, None, 100.0, 3.0, None), (3, -300.0, 0.0, 255.0, -1e300)], "xi int, h double, t double, mark double, d double")
    spec = "h=height:4:0.01:10:-32768, t=time:2:1:0, mark=user_data:1:1:0:0, d=height"
    for options in ({"pointFormat": "7"}, {"pointFormat": "7", "compatible": "true"}, {"pointFormat": "1"}):
        save(df, tmp_path, "overwrite", extra=spec, **options)
        got = [tuple(r) for r in load(spark, tmp_path, columns="xi,attr_0,attr_1,attr_2,attr_3").orderBy("xi").collect()]
        want = [(1, 12.34, -5.0, None, 7.5), (2, None, 100.0, 3.0, 0.0), (3, -300.0, 0.0, 255.0, -1e300)]
        assert [[v if v is None else round(v, 6) if abs(v) < 1e6 else v for v in r] for r in got] == [list(r) for r in want]
        assert spark.read.format("las_headers").load(str(tmp_path)).first().attributes[-4:] == ["height", "time", "user_data", "height"]
    for bad, why in (("h=height:2:0.01", "fit into its type"), ("h=height:11", "no type"), ("h=height:4:0", "scale of zero")):
        with pytest.raises(Exception, match=why):
            save(df, tmp_path, "overwrite", extra=bad)


def test_described_attributes(tmp_path, spark):
    """A file of format 6 made by hand: an attribute with scale, offset and a no-data value, another undocumented."""
    def description(kind, options, name, none=0, scale=1.0, shift=0.0):
        raw = bytearray(192)
        raw[2], raw[3], raw[4:4 + len(name)] = kind, options, name
        struct.pack_into("<q", raw, 40, none)
        struct.pack_into("<d", raw, 112, scale)
        struct.pack_into("<d", raw, 136, shift)
        return bytes(raw)

    described = description(0, 3, b"gap") + description(4, 25, b"depth", -1, 0.5, 10.0) + description(1, 0, b"mark")
    size, start = 30 + 3 + 2 + 1, 375 + 54 + len(described)
    head = bytearray(375)
    head[:4], head[24:26], head[104] = b"LASF", bytes([1, 4]), 6
    struct.pack_into("<HIII", head, 94, 375, start, 1, 0)
    head[104] = 6
    struct.pack_into("<H", head, 105, size)
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    struct.pack_into("<Q", head, 247, 2)
    record = lambda x, depth, mark: struct.pack("<iiiHBBBBhHd", x, 0, 0, 0, 0x21, 0x40, 17, 0, 5000, 9, 2.5) + b"\1\2\3" + struct.pack("<hB", depth, mark)
    data = bytes(head) + struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"") + described + record(7, 6, 200) + record(8, -1, 3)
    (tmp_path / "a.las").write_bytes(data)
    las.register(spark)
    got = [tuple(r) for r in load(spark, tmp_path, columns="xi,attr_0,attr_1,attr_2,scan_angle,ext_return_number,ext_number_of_returns,ext_classification,scan_direction_flag").collect()]
    assert got == [(7, 13.0, 200.0, None, 30.0, 1, 2, 17, 1), (8, None, 3.0, None, 30.0, 1, 2, 17, 1)]
    (tmp_path / "a.las").write_bytes(data[:-1])
    with pytest.raises(Exception, match="before its last record"):
        load(spark, tmp_path).collect()


def test_bounds_skip_files_and_records(spark, sf_dir, tmp_path):
    points = sort_spatially(lineitem_points(spark, sf_dir), 20.0, 4)
    las.register(spark)
    points.write.format("las").option("recordsPerFile", "700").mode("append").save(str(tmp_path))
    where = "x >= 30 AND x < 60 AND y > 20 AND y <= 70"
    scan = lambda: load(spark, tmp_path).where(where).select("xi", "yi", "zi")
    want = sorted(map(tuple, points.where("xi >= 3000 AND xi < 6000 AND yi > 2000 AND yi <= 7000").select("xi", "yi", "zi").collect()))
    assert sorted(map(tuple, scan().collect())) == want and want
    las.write_index(spark, str(tmp_path), 10.0)
    assert sorted(map(tuple, scan().collect())) == want

    def read(*filters):
        reader = las.LasReader({"path": str(tmp_path)})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        parts = reader.partitions()
        return len(parts), sum(n for p in parts for _, n in reader.ranges(p))

    whole = read()
    some = read(las.GreaterThanOrEqual(("x",), 30.0), las.LessThan(("x",), 60.0), las.GreaterThan(("y",), 20.0), las.LessThanOrEqual(("y",), 70.0), las.EqualTo(("intensity",), 5))
    assert whole[1] == points.count() and some[0] < whole[0] and len(want) <= some[1] < whole[1] / 2
    assert load(spark, tmp_path).where("x > 1e9").count() == 0  # no file is left
    (tmp_path / "empty").mkdir()
    for kind in ("las", "las_headers", "las_waveforms"):
        assert spark.read.format(kind).load(str(tmp_path / "empty")).count() == 0
    plan = scan()._jdf.queryExecution().toString()
    assert "PushedFilters" in plan or "BatchScan" in plan


@pytest.mark.parametrize("format_", ["4", "5", "9", "10"])
def test_waveforms(spark, tmp_path, format_):
    """Packets of several lengths beside the points, far apart and in another order than the points; also behind them."""
    rng = np.random.default_rng(1)
    rows = [(100 * i, 0, 50 * i, [int(v) for v in rng.integers(0, 65536, int(rng.choice([3, 40, 64])))] if i % 3 else None, 100.0 * i, 0.001 * i, 0.0, -0.001) for i in range(60)]
    df = spark.createDataFrame(rows, "xi int, yi int, zi int, samples array<int>, wave_location double, wave_xt double, wave_yt double, wave_zt double")
    save(df, tmp_path, pointFormat=format_, spacing="500")
    got = {r.point_index: r for r in spark.read.format("las_waveforms").option("recordsPerPartition", "7").load(str(tmp_path)).collect()}
    assert set(got) == {i for i in range(60) if i % 3}
    for i, r in got.items():
        assert r.samples == list(map(float, rows[i][3])) and r.spacing == 500.0
        assert (r.x, r.z) == pytest.approx((i + 0.1 * i * i, 0.5 * i - 0.1 * i), abs=1e-3) and (r.step_x, r.step_z) == pytest.approx((-0.5 * i, 0.5), abs=1e-4)
    points = load(spark, tmp_path)
    assert points.count() == 60 and points.where("wave_index = 0").count() == 20
    wdp = next(tmp_path.glob("*.wdp"))
    wdp.write_bytes(wdp.read_bytes()[:-2])
    with pytest.raises(Exception, match="before its last sample"):
        spark.read.format("las_waveforms").load(str(tmp_path)).collect()
    save(df, tmp_path, "overwrite", pointFormat="3")
    assert not list(tmp_path.glob("*.wdp")) and spark.read.format("las_waveforms").load(str(tmp_path)).count() == 0


def test_fitting_scaling(spark, tmp_path):
    from pointlake.operators.workflows import fitting_scaling, write_optimized

    points = spark.createDataFrame([(600_000_000 + 100 * i, -5 - i, 7000 * i, "f", i, 9) for i in range(20)], "xi int, yi int, zi int, source_file string, point_index long, user_data int")
    assert fitting_scaling(points) == fitting_scaling(points, False)
    fit = fitting_scaling(points, True)
    assert fit.scale == (1.0, 0.01, 10.0) and fit.offset == (0.0, 0.0, 0.0)
    assert fitting_scaling(points).offset == (6_000_000.0, 0.0, 0.0)
    assert fitting_scaling(points.limit(0)).scale == (0.01, 0.01, 0.01)
    write_optimized(points, str(tmp_path), 16.0)
    got = load(spark, tmp_path)
    assert sorted((r.xi, r.yi, r.zi) for r in got.collect()) == sorted((r.xi, r.yi, r.zi) for r in points.collect()) and got.agg(F.max("user_data")).first()[0] == 0
