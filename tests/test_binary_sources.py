"""Shapefiles and BIL rasters, written here and made by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.sources import binary


def test_shapefile_round_trip(spark, tmp_path):
    binary.register(spark)
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, p)) for p in rng.uniform(-1e6, 1e6, (2500, 3))]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    for mode, n in (("overwrite", 1), ("overwrite", 1), ("append", 2)):
        df.repartition(3).write.format("shapefile").option("record", "64").option("recordsPerFile", "5").mode(mode).save(str(tmp_path))
        got = spark.read.format("shapefile").option("recordsPerPartition", "3").load(str(tmp_path))
        assert sorted((r.x, r.y, r.z) for r in got.collect()) == sorted(rows * n)
    assert got.agg(F.max("part"), F.max("record")).first() == (63, 4) and got.rdd.getNumPartitions() > got.select("source_file").distinct().count()
    for index in tmp_path.glob("*.shx"):
        index.unlink()  # without an index a file is walked
    assert spark.read.format("shapefile").load(str(tmp_path)).count() == 5000
    assert not list(tmp_path.glob("*.waiting"))


def test_other_shapes(spark, tmp_path):
    binary.register(spark)
    contents = [struct.pack("<i2d", 1, 1.5, 2.5), struct.pack("<i", 0), struct.pack("<i4d", 11, 3.0, 4.0, 5.0, 0.0), struct.pack("<i4di4d", 8, 0, 0, 9, 9, 2, 6.0, 7.0, 8.0, 9.0)]
    body = b"".join(struct.pack(">ii", k + 1, len(c) // 2) + c for k, c in enumerate(contents))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8)
    (tmp_path / "a.shp").write_bytes(head + body)
    read = lambda: spark.read.format("shapefile").load(str(tmp_path))
    assert sorted((r.record, r.part, r.x, r.y, r.z) for r in read().where("z IS NULL").collect()) == [(0, 0, 1.5, 2.5, None), (3, 0, 6.0, 7.0, None), (3, 1, 8.0, 9.0, None)]
    assert [(r.record, r.x, r.z) for r in read().where("z IS NOT NULL").collect()] == [(2, 3.0, 5.0)]
    line = struct.pack("<i", 3)
    (tmp_path / "a.shp").write_bytes(head + struct.pack(">ii", 1, 2) + line)
    with pytest.raises(Exception, match="aren't points"):
        read().collect()


@pytest.mark.parametrize(("order", "kind", "pixel", "bits"), [("I", "<i2", "SIGNEDINT", 16), ("M", ">i2", "SIGNEDINT", 16), ("M", ">f4", "FLOAT", 32), ("I", "u1", "UNSIGNEDINT", 8)])
def test_bil_in_either_byte_order(spark, tmp_path, order, kind, pixel, bits):
    binary.register(spark)
    bands = np.arange(24).reshape(2, 3, 4)
    rows = np.stack([bands[:, r] for r in range(3)])  # of each row all bands
    (tmp_path / "a.bil").write_bytes(b"skip" + rows.astype(kind).tobytes())
    (tmp_path / "a.hdr").write_text(f"BYTEORDER {order}\nLAYOUT BIL\nNROWS 3\nNCOLS 4\nNBANDS 2\nNBITS {bits}\nPIXELTYPE {pixel}\nSKIPBYTES 4\nULXMAP 100\nULYMAP 50\nXDIM 10\nYDIM 5\nNODATA 7\n")
    got = spark.read.format("bil").option("cellsPerPartition", "8").load(str(tmp_path))
    want = sorted((b, c, 2 - r, 100.0 + 10 * c, 50.0 - 5 * r, float(bands[b, r, c])) for b in range(2) for r in range(3) for c in range(4) if bands[b, r, c] != 7)
    assert sorted((r.band, r.col, r.row, r.x, r.y, r.value) for r in got.collect()) == want and got.rdd.getNumPartitions() == 3


def test_bil_round_trip(spark, tmp_path):
    binary.register(spark)
    cells = [(c, r, float(c * 100 + r)) for c in range(-5, 20, 3) for r in range(-3, 12)]
    raster = spark.createDataFrame(cells, "col long, row long, value double")
    files = binary.write_bil(raster, str(tmp_path), 2.0, 8, 16).collect()
    assert sum(f.cells for f in files) == len(cells) and len(files) == 9
    got = spark.read.format("bil").load(str(tmp_path))
    assert sorted((r.x, r.y, r.value) for r in got.collect()) == sorted(((c + 0.5) * 2, (r + 0.5) * 2, v) for c, r, v in cells)


def test_no_files(spark, tmp_path):
    binary.register(spark)
    assert [spark.read.format(kind).load(str(tmp_path)).count() for kind in ("shapefile", "bil")] == [0, 0]
