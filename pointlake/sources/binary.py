"""Points of Shapefiles and cells of BIL rasters, as Spark data sources that read ranges of a file.

Both know where each part of a file lies: a Shapefile by its index (.shx), which has an offset for
every record, a BIL raster by the size of a row. So one file is read by many tasks, each opening
it at its own range. Register with `register(spark)`, then read with the formats `shapefile` and
`bil`, and write points with `shapefile`.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Shapes of points, and which of them have heights.
POINT_SHAPES, MULTIPOINT_SHAPES, WITH_Z = (1, 11, 21), (8, 18, 28), (11, 18)
SHAPE_COLUMNS = "source_file string, record long, part int, x double, y double, z double"
BIL_COLUMNS = "source_file string, band int, col long, row long, x double, y double, value double"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, ending: str) -> list[str]:
    store, path = _open(path)
    info = store.get_file_info(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.lower().endswith(ending))


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    count: int
    more: dict = field(default_factory=dict)


def _beside(path: str, ending: str) -> str:
    return path[: path.rindex(".")] + (ending.upper() if path.endswith(("SHP", "BIL")) else ending)


def _shape_points(raw: bytes) -> np.ndarray:
    """x, y and z of a record's content; z is NaN for shapes without."""
    kind = struct.unpack_from("<i", raw)[0]
    if kind == 0:
        return np.zeros((0, 3))
    if kind in POINT_SHAPES:
        return np.array([[*struct.unpack_from("<2d", raw, 4), struct.unpack_from("<d", raw, 20)[0] if kind in WITH_Z else np.nan]])
    if kind not in MULTIPOINT_SHAPES:
        raise ValueError(f"shapes of type {kind} aren't points")
    n = struct.unpack_from("<i", raw, 36)[0]
    xy = np.frombuffer(raw, "<f8", 2 * n, 40).reshape(n, 2)
    z = np.frombuffer(raw, "<f8", n, 40 + 16 * n + 16) if kind in WITH_Z else np.full(n, np.nan)
    return np.column_stack([xy, z])


class ShapeReader(DataSourceReader):
    """A task for each recordsPerPartition records, by the offsets in the index; a file without one is walked by one task."""

    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("recordsPerPartition", 10_000))

    def partitions(self) -> list[InputPartition]:
        store, out = _open(self.path)[0], []
        for path in _files(self.path, ".shp"):
            info = store.get_file_info(_beside(path, ".shx"))
            if not info.is_file:
                out.append(_Part(path, 0, -1))
                continue
            n = (info.size - 100) // 8
            out += [_Part(path, a, min(self.each, n - a)) for a in range(0, n, self.each)]
        return out

    def offsets(self, store: fs.FileSystem, part: _Part) -> Iterator[tuple[int, int]]:
        """(place, size) of the contents of the part's records."""
        if part.count >= 0:
            with store.open_input_file(_beside(part.path, ".shx")) as index:
                table = np.frombuffer(index.read_at(8 * part.count, 100 + 8 * part.first), ">i4").reshape(-1, 2).astype(np.int64) * 2
            yield from ((int(at) + 8, int(size)) for at, size in table)
            return
        with store.open_input_file(part.path) as file:
            at, end = 100, file.size()
            while at + 8 <= end:
                size = struct.unpack(">ii", file.read_at(8, at))[1] * 2
                yield at + 8, size
                at += 8 + size

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        store = _open(self.path)[0]
        with store.open_input_file(part.path) as file:
            if struct.unpack(">i", file.read_at(4, 0))[0] != 9994:
                raise ValueError(f"{part.path} is not a shapefile")
            rows, held = [], 0
            for k, (at, size) in enumerate(self.offsets(store, part)):
                points = _shape_points(file.read_at(size, at))
                rows.append((part.first + k, points))
                held += len(points)
                if held > 100_000:
                    yield self.batch(part.path, rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(part.path, rows)

    @staticmethod
    def batch(path: str, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        points = np.concatenate([p for _, p in rows])
        record = np.repeat([r for r, _ in rows], [len(p) for _, p in rows]).astype(np.int64)
        place = np.concatenate([np.arange(len(p)) for _, p in rows]).astype(np.int32)
        z = pa.array(points[:, 2], mask=np.isnan(points[:, 2]))
        arrays = [pa.array([path] * len(points), pa.string()), pa.array(record), pa.array(place), pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy()), z]
        return pa.RecordBatch.from_arrays(arrays, ["source_file", "record", "part", "x", "y", "z"])


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


class FileWriter(DataSourceArrowWriter):
    """Files are written under waiting names and moved when all tasks are done; overwriting then deletes the old ones of the same endings."""

    endings: tuple[str, ...] = ()

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def save_batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
        """(ending, content) of the files that belong together, for each such set."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        out, (store, path) = _Written(), _open(self.path)
        for files in self.save_batches(iterator):
            store.create_dir(path, recursive=True)
            name = uuid.uuid4().hex
            for ending, content in files:
                with store.open_output_stream(f"{path}/_{name}{ending}.waiting") as stream:
                    stream.write(content)
                out.moves.append((f"{path}/_{name}{ending}.waiting", f"{path}/part-{name}{ending}"))
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _open(self.path)
        old = []
        if self.overwrite and store.get_file_info(path).type == fs.FileType.Directory:
            old = [file for ending in self.endings for file in _files(self.path, ending)]
        for waiting, final in (m for message in messages if message is not None for m in message.moves):
            store.move(waiting, final)
        for file in old:
            store.delete_file(file)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _open(self.path)
        for waiting, _final in (m for message in messages if message is not None for m in message.moves):
            store.delete_file(waiting)


class ShapeWriter(FileWriter):
    """Multipoints with heights, of `record` points each (256 by default), and their index; x, y and z of the rows. A file holds at most recordsPerFile records."""

    endings = (".shp", ".shx")

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.size, self.each = int(options.get("record", 256)), int(options.get("recordsPerFile", 4_000))

    def save_batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
        left, whole = np.zeros((0, 3)), self.size * self.each
        for batch in iterator:
            rows = np.column_stack([pc.fill_null(batch.column(batch.schema.get_field_index(c)).cast(pa.float64()), 0.0).to_numpy() for c in "xyz"])
            left = np.concatenate([left, rows])
            while len(left) >= whole:
                yield self.files(left[:whole])
                left = left[whole:]
        if len(left):
            yield self.files(left)

    def files(self, points: np.ndarray) -> list[tuple[str, bytes]]:
        records, index, at = [], [], 50
        for k in range(0, len(points), self.size):
            p = points[k : k + self.size]
            low, high = p.min(0), p.max(0)
            body = struct.pack("<i4di", 18, low[0], low[1], high[0], high[1], len(p)) + p[:, :2].astype("<f8").tobytes()
            body += struct.pack("<2d", low[2], high[2]) + p[:, 2].astype("<f8").tobytes()
            records.append(struct.pack(">ii", len(records) + 1, len(body) // 2) + body)
            index.append(struct.pack(">ii", at, len(body) // 2))
            at += 4 + len(body) // 2
        low, high = points.min(0), points.max(0)
        head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 18, low[0], low[1], high[0], high[1], low[2], high[2], 0.0, 0.0)
        return [(".shx", head(50 + 4 * len(index)) + b"".join(index)), (".shp", head(at) + b"".join(records))]


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SHAPE_COLUMNS

    def reader(self, schema: object) -> ShapeReader:
        return ShapeReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(self.options, overwrite)


def bil_header(text: str) -> dict:
    """The lines of a raster's .hdr file, with what is left out there."""
    given = {w[0].lower(): w[1] for w in (line.split() for line in text.splitlines()) if len(w) > 1}
    num = lambda key, default: float(given.get(key, default))
    rows, cols, bands, bits = (int(num(k, d)) for k, d in (("nrows", 0), ("ncols", 0), ("nbands", 1), ("nbits", 8)))
    pixel = given.get("pixeltype", "UNSIGNEDINT").upper()
    kind = "f" if pixel.startswith("FLOAT") else "i" if pixel.startswith("SIGNED") else "u"
    order = ">" if given.get("byteorder", "I").upper() in ("M", "MSBFIRST") else "<"
    if given.get("layout", "bil").lower() != "bil" or bits not in (8, 16, 32, 64):
        raise ValueError("only rows of bands of whole bytes are read")
    size = bits // 8 * cols
    return {
        "rows": rows, "cols": cols, "bands": bands, "type": f"{order}{kind}{bits // 8}", "skip": int(num("skipbytes", 0)),
        "band_row": int(num("bandrowbytes", size)), "row": int(num("totalrowbytes", int(num("bandrowbytes", size)) * bands)),
        "left": num("ulxmap", 0.5), "top": num("ulymap", rows - 0.5), "dx": num("xdim", 1.0), "dy": num("ydim", 1.0),
        "none": float(given["nodata"]) if "nodata" in given else None,
    }


class BilReader(DataSourceReader):
    """A task for about cellsPerPartition cells, in whole rows; row 0 is the lowest, x and y are the cells' middles."""

    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("cellsPerPartition", 4_000_000))

    def partitions(self) -> list[InputPartition]:
        store, out = _open(self.path)[0], []
        for path in _files(self.path, ".bil"):
            with store.open_input_file(_beside(path, ".hdr")) as file:
                head = bil_header(file.read().decode("latin-1"))
            step = max(1, self.each // max(1, head["cols"] * head["bands"]))
            out += [_Part(path, a, min(step, head["rows"] - a), head) for a in range(0, head["rows"], step)]
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, h = _open(self.path)[0], part.more
        with store.open_input_file(part.path) as file:
            for r in range(part.first, part.first + part.count):
                raw = file.read_at(h["row"], h["skip"] + r * h["row"])
                for band in range(h["bands"]):
                    value = np.frombuffer(raw, h["type"], h["cols"], band * h["band_row"]).astype(float)
                    col = np.flatnonzero(~np.isnan(value) & (value != h["none"] if h["none"] is not None else True))
                    n = len(col)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path] * n, pa.string()), pa.array(np.full(n, band, np.int32)), pa.array(col.astype(np.int64)), pa.array(np.full(n, h["rows"] - 1 - r)),
                         pa.array(h["left"] + col * h["dx"]), pa.array(np.full(n, h["top"] - r * h["dy"])), pa.array(value[col])],
                        ["source_file", "band", "col", "row", "x", "y", "value"],
                    )


class BilSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bil"

    def schema(self) -> str:
        return BIL_COLUMNS

    def reader(self, schema: object) -> BilReader:
        return BilReader(self.options)


def write_tiles(raster: DataFrame, path: str, rows_per_file: int, cols_per_file: int, none: float, tile: Callable[[np.ndarray, int, int], list[tuple[str, bytes]]]) -> DataFrame:
    """Writes a raster (col, row, value) as tiles, highest row first, each by one task; `tile` makes (ending, content) of its files. Gives source_file (the last) and cells of each."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        tc, tr = int(frame["tc"].iloc[0]), int(frame["tr"].iloc[0])
        cells = np.full((rows_per_file, cols_per_file), none, "<f4")
        cells[rows_per_file - 1 - (frame["row"] - tr * rows_per_file), frame["col"] - tc * cols_per_file] = frame["value"]
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/tile_{tc}_{tr}"
        for ending, content in tile(cells, tc, tr):
            with store.open_output_stream(name + ending) as out:
                out.write(content)
        return pd.DataFrame({"source_file": [name + ending], "cells": [len(frame)]})

    dealt = raster.where("value IS NOT NULL").withColumns({"tc": F.floor(F.col("col") / cols_per_file), "tr": F.floor(F.col("row") / rows_per_file)})
    return dealt.select("tc", "tr", "col", "row", "value").groupBy("tc", "tr").applyInPandas(write, "source_file string, cells long")


def write_bil(raster: DataFrame, path: str, step: float, rows_per_file: int = 256, cols_per_file: int = 4096, none: float = -9999.0) -> DataFrame:
    """Writes a raster (col, row, value) as tiles of 32-bit floats, each file by one task; gives source_file and cells of each. Written when the result is."""

    def tile(cells: np.ndarray, tc: int, tr: int) -> list[tuple[str, bytes]]:
        head = {
            "nrows": rows_per_file, "ncols": cols_per_file, "nbands": 1, "nbits": 32, "pixeltype": "FLOAT", "byteorder": "I", "layout": "bil", "nodata": none,
            "ulxmap": (tc * cols_per_file + 0.5) * step, "ulymap": ((tr + 1) * rows_per_file - 0.5) * step, "xdim": step, "ydim": step,
        }
        return [(".hdr", "".join(f"{k} {v}\n" for k, v in head.items()).encode()), (".bil", cells.tobytes())]

    return write_tiles(raster, path, rows_per_file, cols_per_file, none, tile)


def register(spark: SparkSession) -> None:
    for source in (ShapeSource, BilSource):
        spark.dataSource.register(source)
