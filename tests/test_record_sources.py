"""Files of fixed-size records: written and read, and made by hand."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.sources import records

POINTS = [
    # x, y, z, intensity, return_number, number_of_returns, classification, point_source_id, gps_time, red, green, blue
    (1.25, -2.5, 3.75, 70, 1, 1, 2, 9, 0.5, 256, 512, 65280),
    (100000.5, 200000.25, -30.0, 16383, 1, 3, 5, 300, 1234.5678, 0, 0, 0),
    (7.0, 8.0, 9.0, 20000, 2, 3, 1, 1, 604799.0, 2560, 0, 256),
    (0.0, 0.0, 0.0, 0, 3, 3, 31, 65535, 0.0, 0, 65280, 0),
]
SCHEMA = "x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, point_source_id int, gps_time double, red int, green int, blue int"


@pytest.fixture(autouse=True)
def _registered(spark):
    records.register(spark)


def _points(spark):
    return spark.createDataFrame(POINTS, SCHEMA)


def _save(df, kind, path, mode="append", **options):
    df.write.format(kind).options(**options).mode(mode).save(str(path))


def _load(spark, kind, path, **options):
    return spark.read.format(kind).options(**options).load(str(path))


def test_terrasolid_round_trip(spark, tmp_path):
    for mode, times in (("overwrite", 1), ("overwrite", 1), ("append", 2)):
        _save(_points(spark).repartition(2), "terrasolid", tmp_path, mode, offset="100,0,-5", recordsPerFile="2")
        got = _load(spark, "terrasolid", tmp_path, recordsPerPartition="1")
        rows = sorted(tuple(round(v, 6) for v in r) for r in got.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect())
        # of three returns, a middle one stays 2 of 3, the first is 1 of 2 and the last 2 of 2; times are in steps of 0.0002
        returns = {(1, 1): (1, 1), (1, 3): (1, 2), (2, 3): (2, 3), (3, 3): (2, 2)}
        want = [(*p[:4], *returns[p[4:6]], *p[6:8], round(round(p[8] / 0.0002) * 0.0002, 6), *p[9:]) for p in POINTS]
        assert rows == sorted(want * times) and got.rdd.getNumPartitions() == 4 * times
    assert {(r.xi, r.x) for r in got.collect()} == {(round(p[0] * 100), p[0]) for p in POINTS}


def test_terrasolid_narrow_records_and_absent_fields(spark, tmp_path):
    _save(_points(spark), "terrasolid", tmp_path, layout="ts8", time="false", colour="false", scale="0.001")
    got = _load(spark, "terrasolid", tmp_path).orderBy("z").collect()
    assert [(r.z, r.intensity, r.point_source_id, r.gps_time, r.red) for r in got] == [(p[2], p[3] & 0x3FFF, p[7] & 255, None, None) for p in sorted(POINTS, key=lambda p: p[2])]


def test_terrasolid_by_hand(spark, tmp_path):
    head = struct.pack("<3i4s2i3d2i", 56, 20020715, 970401, b"CXYZ", 2, 100, 1000.0, 0.0, -500.0, 1, 0)
    body = struct.pack("<3i4B2HI", 1100, 50, 0, 6, 7, 0, 0, 12, 65535, 5000) + struct.pack("<3i4B2HI", 1000, 0, 0, 7, 3, 0, 0, 13, 1, 0)
    (tmp_path / "A.BIN").write_bytes(head + body)
    rows = [(r.point_index, round(r.x, 6), r.y, round(r.z, 6), r.intensity, r.return_number, r.number_of_returns, r.classification, r.point_source_id, r.gps_time) for r in _load(spark, "terrasolid", tmp_path).collect()]
    assert sorted(rows) == [(0, 1.0, 0.5, 5.0, 65535, 2, 3, 6, 12, 1.0), (1, 0.0, 0.0, 5.0, 1, 2, 2, 7, 13, 0.0)]
    for bad, why in ((head + body[:-1], "shorter"), (b"\0" + head + body, "not a Terrasolid"), (head[:30], "not a Terrasolid")):
        (tmp_path / "A.BIN").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            _load(spark, "terrasolid", tmp_path).collect()


@pytest.mark.parametrize("size", [40, 48, 56])
@pytest.mark.parametrize("order", ["<", ">"])
def test_qfit_in_either_byte_order(spark, tmp_path, order, size):
    rows = [[1500, 45_000_001, 350_000_000, 12_345, 0, 77, 190_400, -1_500, 2_250], [2500, -5, 10, -7, 0, 5, 20_000, 0, 0]]
    body = b"".join(struct.pack(f"{order}{size // 4}i", *r, *([99] * (size // 4 - 9))) for r in rows)
    head = struct.pack(order + "i", size).ljust(size, b"\0") + struct.pack(order + "2i", -9_000_000, 2 * size).ljust(size, b"\0")
    (tmp_path / "a.qi").write_bytes(head + body)
    got = sorted(_load(spark, "qfit", tmp_path, recordsPerPartition="1").collect(), key=lambda r: r.point_index)
    assert [(round(r.x, 6), round(r.y, 6), round(r.z, 3), r.gps_time, r.intensity, r.scan_angle_rank) for r in got] == [(-10.0, 45.000001, 12.345, 1.5, 77, 10), (0.00001, -0.000005, -0.007, 2.5, 5, -128)]
    assert (round(got[0].scan_azimuth, 3), round(got[0].pitch, 3), round(got[0].roll, 3), got[0].pulse_width) == (190.4, -1.5, 2.25, 99 if size == 48 else None)


def test_qfit_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(-120.5, 38.25, 1500.125, 86399.999, 12, 200.0, -1.0, 3), (179.0, -89.0, -2.0, 0.0, 1, 90.0, 2.0, 255)], "x double, y double, z double, gps_time double, intensity int, scan_azimuth double, pitch double, pulse_width int")
    _save(df, "qfit", tmp_path)
    got = [tuple(round(v, 6) for v in r) for r in _load(spark, "qfit", tmp_path).select(*df.columns).collect()]
    assert sorted(got) == sorted(map(tuple, df.collect()))
    for wrong, why in (({"x": 400.0}, "longitudes"), ({"gps_time": 1e9}, "don't fit")):
        with pytest.raises(Exception, match=why):
            _save(df.withColumns({k: F.lit(v) for k, v in wrong.items()}), "qfit", tmp_path)
    assert _load(spark, "qfit", tmp_path).count() == 2 and not list(tmp_path.glob("*.waiting"))


@pytest.mark.parametrize("order", ["<", ">"])
def test_ply_in_either_byte_order(spark, tmp_path, order):
    name = {"<": "little", ">": "big"}[order]
    head = f"ply\nformat binary_{name}_endian 1.0\ncomment made by hand\nelement camera 2\nproperty short id\nelement vertex 3\nproperty uchar red\nproperty float x\nproperty float y\nproperty double z\nproperty float nx\nproperty int label\nproperty float gray\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = struct.pack(order + "2h", 1, 2) + b"".join(struct.pack(order + "B2fdfif", 10 * k, k + 0.5, -k, z, 0.25, -k, 6.6) for k, z in enumerate((1.5, float("nan"), 3.0))) + b"\3" + struct.pack(order + "3i", 0, 1, 2)
    (tmp_path / "a.ply").write_bytes(head.encode() + body)
    got = sorted(_load(spark, "ply", tmp_path, recordsPerPartition="2").collect(), key=lambda r: r.point_index)
    assert [(r.x, r.y, r.xi, r.yi, r.zi, r.red, r.green, r.intensity, r.attr_0, r.attr_1, r.attr_2) for r in got] == [(k + 0.5, -k, 50 + 100 * k, -100 * k, z, 10 * k, None, 7, 0.25, -k, None) for k, z in enumerate((150, None, 300))]
    for old, new, why in (("element camera 2\nproperty short id", "element camera 2\nproperty list uchar short id", "lists"), (f"binary_{name}_endian", "ascii", "text"), ("vertex 3", "vertex 4000", "shorter"), ("ply\n", "plx\n", "not a PLY")):
        (tmp_path / "a.ply").write_bytes(head.replace(old, new).encode() + body)
        with pytest.raises(Exception, match=why):
            _load(spark, "ply", tmp_path).collect()


def test_ply_round_trip(spark, tmp_path):
    _save(_points(spark), "ply", tmp_path, recordsPerFile="3")
    got = _load(spark, "ply", tmp_path).select("x", "y", "z", "intensity", "red", "green", "blue").collect()
    assert sorted(map(tuple, got)) == sorted((*p[:4], *(c // 256 for c in p[9:])) for p in POINTS)


@pytest.mark.parametrize(("kind", "type_"), [(0, "<i2"), (1, "<i4"), (2, "<f4"), (3, "<f8")])
def test_dtm_types(spark, tmp_path, kind, type_):
    cells = np.arange(12).reshape(3, 4).astype(type_)  # columns of rows from the lowest
    cells[1, 2] = -9999
    head = struct.pack("<21s61sf7d2i7h", b"PLANS-PC BINARY .DTM\0", b"", 3.1, 1000.0, 2000.0, 0, 11, 0, 10.0, 5.0, 3, 4, 1, 1, kind, 0, 0, 0, 0).ljust(200, b"\0")
    (tmp_path / "a.dtm").write_bytes(head + cells.tobytes())
    got = _load(spark, "dtm", tmp_path, cellsPerPartition="4")
    want = sorted((c, r, 1005.0 + 10 * c, 2002.5 + 5 * r, float(cells[c, r])) for c in range(3) for r in range(4) if (c, r) != (1, 2))
    assert sorted(map(tuple, got.drop("source_file").collect())) == want and got.rdd.getNumPartitions() == 3
    for bad, why in ((head + cells.tobytes()[:-1], "shorter"), (b"x" + head + cells.tobytes(), "not a DTM")):
        (tmp_path / "a.dtm").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            _load(spark, "dtm", tmp_path).collect()


def test_dtm_round_trip(spark, tmp_path):
    cells = [(c, r, float(c * 100 + r)) for c in range(-5, 20, 3) for r in range(-3, 12)]
    raster = spark.createDataFrame(cells, "col long, row long, value double")
    assert sum(f.cells for f in records.write_dtm(raster, str(tmp_path), 2.0, 8, 16).collect()) == len(cells)
    assert sorted((r.x, r.y, r.value) for r in _load(spark, "dtm", tmp_path).collect()) == sorted(((c + 0.5) * 2, (r + 0.5) * 2, v) for c, r, v in cells)


def test_vrml(spark, tmp_path):
    _save(_points(spark).coalesce(1), "vrml", tmp_path / "a")
    _save(_points(spark).coalesce(1), "vrml", tmp_path / "b", colour="false", decimals="3")
    text, plain = (next((tmp_path / d).glob("*.wrl")).read_text() for d in "ab")
    blocks = [[tuple(map(float, line.split())) for line in b.strip().splitlines()] for b in re.findall(r"\[([^\]]*)\]", text)]
    assert blocks[0] == [p[:3] for p in POINTS] and blocks[1][0] == (0.0, 0.01, 1.0) and len(blocks[1]) == 4
    assert text.startswith("#VRML V2.0 utf8\nShape {") and "emissiveColor" in plain and "color Color" not in plain and "100000.500 200000.250 -30.000" in plain
    with pytest.raises(Exception, match="aren't read"):
        _load(spark, "vrml", tmp_path / "a").collect()


def test_nulls_empty_rows_and_no_files(spark, tmp_path):
    assert [_load(spark, kind, tmp_path).count() for kind in ("terrasolid", "qfit", "ply", "dtm")] == [0] * 4
    nothing = spark.createDataFrame([(None, None, None, None)], "x double, y double, z double, intensity int")
    for kind in ("terrasolid", "qfit", "ply"):
        _save(nothing, kind, tmp_path / kind)
        _save(nothing.limit(0), kind, tmp_path / kind)
        assert [(r.x, r.y, r.z, r.intensity) for r in _load(spark, kind, tmp_path / kind).collect()] == [(0.0, 0.0, 0.0, 0)]
