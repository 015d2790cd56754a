"""Scans of terrestrial scanners as PTX text: ten lines of a header, then a line a point.

A file is read by many tasks: each has a range of its bytes and reads the lines that start there.
A file holds one scan, as the header of a second would be among its lines of points. Points
without a return (zeros) are kept. Register with `register(spark)` to write the format `ptx`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointlake.schema import DEFAULT_SCALE, ScaleOffset
from pointlake.sources.binary import FileWriter, _files, _open, _Part
from pointlake.sources.text import from_text

#: Fixed value: lines of the header: columns, rows, the scanner's place, its three axes, four rows of the matrix.
HEADER_LINES = 10
COLUMNS = "source_file string, cols long, rows long, scanner array<double>, matrix array<double>, value string"
_STEP, _LINES = 1 << 20, 50_000


def header(raw: bytes) -> dict:
    """cols, rows, scanner and matrix (by rows) of a file, and the byte where its points start."""
    lines = raw.split(b"\n", HEADER_LINES)
    if len(lines) <= HEADER_LINES:
        raise ValueError("a PTX file without a whole header")
    numbers = [[float(w) for w in line.split()] for line in lines[:HEADER_LINES]]
    if [len(n) for n in numbers] != [1, 1, 3, 3, 3, 3, 4, 4, 4, 4]:
        raise ValueError("not a PTX file")
    start = sum(len(line) + 1 for line in lines[:HEADER_LINES])
    return {"cols": int(numbers[0][0]), "rows": int(numbers[1][0]), "scanner": numbers[2], "matrix": sum(numbers[6:], []), "start": start}


class PtxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("bytesPerPartition", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        store, out = _open(self.path)[0], []
        for path in _files(self.path, ".ptx"):
            with store.open_input_file(path) as file:
                head, end = header(file.read_at(8192, 0)), file.size()
            out += [_Part(path, a, min(self.each, end - a), head) for a in range(head["start"], end, self.each)]
        return out

    @staticmethod
    def lines(file: pa.NativeFile, first: int, end: int, start: int) -> Iterator[bytes]:
        """Lines that start from first to before end: the one across a range's start is the range's before it."""
        at, left = first, b""
        if first > start:  # from the byte before, so that a line that starts at first is found
            at = first - 1
            while True:
                raw = file.read_at(_STEP, at)
                cut = raw.find(b"\n")
                at += cut + 1 if cut >= 0 else len(raw)
                if cut >= 0 or not raw:
                    break
        begins = at  # of what is left
        while begins < end:
            raw = file.read_at(_STEP, at)
            at += len(raw)
            *whole, left = (left + raw).split(b"\n")
            if not raw:
                whole, left = ([left] if left else []), b""
            for line in whole:
                if begins >= end:
                    return
                yield line
                begins += len(line) + 1
            if not raw:
                return

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        head, held = part.more, []
        with _open(self.path)[0].open_input_file(part.path) as file:
            for line in self.lines(file, part.first, part.first + part.count, head["start"]):
                held.append(line.decode("latin-1").strip())
                if len(held) == _LINES:
                    yield self.batch(part.path, head, held)
                    held = []
        if held:
            yield self.batch(part.path, head, held)

    @staticmethod
    def batch(path: str, head: dict, lines: list[str]) -> pa.RecordBatch:
        same = pa.array(np.zeros(len(lines), np.int32))
        kinds = {"cols": pa.int64(), "rows": pa.int64(), "scanner": pa.list_(pa.float64()), "matrix": pa.list_(pa.float64())}
        arrays = [pa.array([path]).take(same), *(pa.array([head[c]], t).take(same) for c, t in kinds.items()), pa.array(lines)]
        return pa.RecordBatch.from_arrays(arrays, ["source_file", *kinds, "value"])


class PtxWriter(FileWriter):
    """x, y, z and strength (0 to 1) of the rows, as one column of points a file. Options: matrix (sixteen numbers by rows), recordsPerFile (1,000,000)."""

    endings = (".ptx",)

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.each = int(options.get("recordsPerFile", 1_000_000))
        self.matrix = [float(v) for v in options.get("matrix", "1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1").split(",")]

    def whole(self, rows: np.ndarray) -> bytes:
        m = np.array(self.matrix).reshape(4, 4)
        head = ["1", str(len(rows)), *(" ".join(map(repr, map(float, v))) for v in (m[3, :3], *m[:3, :3], *m))]
        return ("\n".join([*head, *(f"{x:.6f} {y:.6f} {z:.6f} {s:.6f}" for x, y, z, s in rows)]) + "\n").encode()

    def save_batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
        left = np.zeros((0, 4))
        for batch in iterator:
            column = lambda c, b=batch: pc.fill_null(b.column(c).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) if c in b.schema.names else np.zeros(b.num_rows)
            left = np.concatenate([left, np.column_stack([column(c) for c in ("x", "y", "z", "strength")])])
            while len(left) >= self.each:
                yield [(".ptx", self.whole(left[: self.each]))]
                left = left[self.each :]
        if len(left):
            yield [(".ptx", self.whole(left))]


class PtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ptx"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: object) -> PtxReader:
        return PtxReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> PtxWriter:
        return PtxWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PtxSource)


def read_ptx(spark: SparkSession, path: str, parse: str = "xyzi", moved: bool = False, scaling: ScaleOffset = DEFAULT_SCALE, **options: str) -> DataFrame:
    """Points with source_file. An intensity i of 0 to 1 becomes 0 to 4095; moved: places are the world's, by the header's matrix, else the scanner's."""
    register(spark)
    lines = spark.read.format("ptx").options(**options).load(path)
    # plain numbers first: the matrix and the intensity's scale are applied before rounding
    digit = {letter: str(k) for k, letter in enumerate("xyzi")}
    names = {f"attr_{d}": letter for letter, d in digit.items()}
    read = from_text(lines, "".join(digit.get(c, c) for c in parse), keep=("source_file", "matrix"))
    place = [F.col(f"attr_{k}") for k in range(3)]
    if moved:
        place = [sum((place[j] * F.col("matrix")[4 * j + k] for j in range(3)), F.col("matrix")[12 + k]) for k in range(3)]
    made = {f"{a}i": scaling.raw(a, place[k]) for k, a in enumerate("xyz")}
    if "i" in parse:
        made["intensity"] = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("attr_3"))) * 4095).cast("int")
    kept = read.where(" AND ".join(f"attr_{k} IS NOT NULL" for k in range(3)))
    return kept.select("source_file", *[v.alias(c) for c, v in made.items()], *[c for c in read.columns if c not in ("source_file", "matrix", *names)])
