"""PTX scans: ranges of bytes that cut lines anywhere, matrices, odd files."""

import pytest

from pointlake.sources import ptx

HEAD = "2\n3\n1.5 2.5 3.5\n1 0 0\n0 1 0\n0 0 1\n0 1 0 0\n-1 0 0 0\n0 0 1 0\n100 200 300 1\n"


@pytest.mark.parametrize("size", ["1", "7", "8", "50", "1000000"])
@pytest.mark.parametrize("end", ["\n", "", "\n\n", "\r\n"])
def test_ranges(spark, tmp_path, size, end):
    lines = [f"{k}.25 {k} -{k}.5 {k / 10} {k} 0 {255 - k}" for k in range(6)]
    (tmp_path / "a.ptx").write_bytes((HEAD + "\n".join(lines) + end).encode())
    ptx.register(spark)
    read = spark.read.format("ptx").option("bytesPerPartition", size).load(str(tmp_path))
    assert sorted(r.value for r in read.collect() if r.value) == sorted(lines)
    assert {(r.cols, r.rows, tuple(r.scanner), r.matrix[12]) for r in read.collect()} == {(2, 3, (1.5, 2.5, 3.5), 100.0)}


def test_points(spark, tmp_path):
    (tmp_path / "a.ptx").write_text(HEAD + "1 2 3 0.5 9 8 7\n0 0 0 0.5\nbad line of words 1 2 3\n-1 0 0.125 7 1 2 3\n")
    got = sorted(tuple(r[1:]) for r in ptx.read_ptx(spark, str(tmp_path)).collect())
    assert got == [(-100, 0, 13, 4095), (0, 0, 0, 2048), (100, 200, 300, 2048)]
    moved = ptx.read_ptx(spark, str(tmp_path), "xyziRGB", moved=True)
    assert sorted(tuple(r[1:]) for r in moved.collect()) == [(9800, 20100, 30300, 2048, 9, 8, 7), (10000, 19900, 30013, 4095, 1, 2, 3)]
    assert moved.columns == ["source_file", "xi", "yi", "zi", "intensity", "red", "green", "blue"]


def test_long_lines_cross_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ptx, "_STEP", 3)
    path = tmp_path / "a.ptx"
    path.write_text(HEAD + "".join(f"{k} {'1' * (k % 9)} 3\n" for k in range(40)))
    reader = ptx.PtxReader({"path": str(path), "bytesPerPartition": "10"})
    values = [v for part in reader.partitions() for b in reader.read(part) for v in b.column("value").to_pylist()]
    assert values == [" ".join([str(k), "1" * (k % 9), "3"]) for k in range(40)]


def test_round_trip_and_odd_files(spark, tmp_path):
    ptx.register(spark)
    assert spark.read.format("ptx").load(str(tmp_path)).count() == 0
    df = spark.createDataFrame([(1.5, -2.0, 3.25, 0.5), (None, None, None, None), (7.0, 8.0, 9.0, 1.0)], "x double, y double, z double, strength double")
    for mode, n in (("overwrite", 1), ("overwrite", 1), ("append", 2)):
        df.coalesce(1).write.format("ptx").option("recordsPerFile", "2").mode(mode).save(str(tmp_path))
        got = ptx.read_ptx(spark, str(tmp_path))
        assert sorted(tuple(r[1:]) for r in got.collect()) == sorted([(150, -200, 325, 2048), (0, 0, 0, 0), (700, 800, 900, 4095)] * n)
    (tmp_path / "only_header.ptx").write_text(HEAD)
    assert got.count() == 6
    for bad, why in (("1\n2\n", "whole header"), ("1 2\n" * 12, "not a PTX")):
        (tmp_path / "bad.ptx").write_text(bad)
        with pytest.raises(Exception, match=why):
            spark.read.format("ptx").load(str(tmp_path)).collect()
