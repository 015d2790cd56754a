"""Points in files of fixed-size records: Terrasolid BIN, QFIT and binary PLY; DTM rasters; VRML to look at.

A record's place follows from its number, so one file is read by many tasks, each at its own range,
and only headers are read on the driver. Register with `register(spark)`; formats `terrasolid`,
`qfit` and `ply` are read and written, `dtm` is read (`write_dtm` writes one), `vrml` is written.
Files of no points, and folders of no files, give no rows; a file shorter than its header says is an
error. What a writer's rows lack, and nulls, are zeros.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointlake.schema import DEFAULT_SCALE
from pointlake.sources.binary import FileWriter, _files, _open, _Part, write_tiles
from pointlake.sources.las import _ARROW, _raw

BATCH = 100_000
_PLACE = {"source_file": "string", "point_index": "long", "x": "double", "y": "double", "z": "double"}
_STEPS = {f"{a}i": "int" for a in "xyz"}

#: Header and both kinds of records of Terrasolid files; a time is in steps of 0.0002 seconds, a return's echo is only, first, middle or last.
TS_HEADER, TS_MAGIC, TS_WIDE, TS_NARROW, TS_TICK = "<3i4s2i3d2i", 970401, 20020715, 20010712, 0.0002
_TS_WIDE = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("code", "u1"), ("echo", "u1"), ("flag", "u1"), ("mark", "u1"), ("line", "<u2"), ("intensity", "<u2")]
_TS_NARROW = [("code", "u1"), ("line", "u1"), ("echo", "<u2"), ("x", "<i4"), ("y", "<i4"), ("z", "<i4")]
_ECHO_RETURN, _ECHO_RETURNS = np.array([1, 1, 2, 2], np.int32), np.array([1, 2, 3, 2], np.int32)

#: Bytes of a QFIT record, its words, the mark of its second header record.
QFIT_SIZES, QFIT_MARK = (40, 48, 56), -9_000_000
_QFIT = ("time", "latitude", "longitude", "height", "sent", "intensity", "azimuth", "pitch", "roll")

#: Types of PLY properties.
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
_PLY_WRITTEN = [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("intensity", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]

#: The start of a DTM header, the types of its heights by number, the height of an empty cell.
DTM_HEADER, DTM_NAME, DTM_TYPES, DTM_NONE = "<21s61sf7d2i7h", b"PLANS-PC BINARY .DTM\0", ("<i2", "<i4", "<f4", "<f8"), -9999.0


def _round(value: np.ndarray, kind: str) -> np.ndarray:
    """The nearest integers, halves away from zero; an error where one doesn't fit."""
    whole = np.trunc(value + np.copysign(0.5, value))
    limits = np.iinfo(kind)
    if len(whole) and not (limits.min <= whole.min() and whole.max() <= limits.max):
        raise ValueError(f"values from {value.min()} to {value.max()} don't fit into the file's {kind}")
    return whole.astype(kind)


def _steps(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the library's steps; null where they aren't finite."""
    no = ~np.isfinite(x)
    return _raw(np.where(no, 0.0, x), DEFAULT_SCALE.scale[k], DEFAULT_SCALE.offset[k]), no


def _batch(path: str, first: int, n: int, columns: dict[str, str], made: dict) -> pa.RecordBatch:
    made |= {"source_file": pa.array([path]).take(pa.array(np.zeros(n, np.int32))), "point_index": np.arange(first, first + n)}
    arrays = []
    for name, kind in columns.items():
        value, kind = made.get(name), _ARROW[kind]
        if value is None:
            arrays.append(pa.nulls(n, kind))
        elif isinstance(value, pa.Array):
            arrays.append(value)
        else:
            value, mask = value if isinstance(value, tuple) else (value, None)
            arrays.append(pa.array(np.ascontiguousarray(value).astype(kind.to_pandas_dtype()), mask=mask))
    return pa.RecordBatch.from_arrays(arrays, list(columns))


class RecordReader(DataSourceReader):
    """A task for each recordsPerPartition records. Kinds of files say how a header is read (`head`) and what records mean (`columns`, `made`)."""

    ending, columns = "", {}

    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("recordsPerPartition", 1_000_000))

    def head(self, file: pa.NativeFile) -> dict:
        """start, type and n: where records start, what they are, and how many."""
        raise NotImplementedError

    def made(self, rows: np.ndarray, head: dict) -> dict:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        store, out = _open(self.path)[0], []
        for path in _files(self.path, self.ending):
            with store.open_input_file(path) as file:
                head = self.head(file)
                if head["start"] + head["n"] * head["type"].itemsize > file.size():
                    raise ValueError(f"{path} is shorter than its header says")
            out += [_Part(path, a, min(self.each, head["n"] - a), head) for a in range(0, head["n"], self.each)]
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        head, size = part.more, part.more["type"].itemsize
        with _open(self.path)[0].open_input_file(part.path) as file:
            for a in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - a)
                rows = np.frombuffer(file.read_at(n * size, head["start"] + a * size), head["type"])
                yield _batch(part.path, a, n, self.columns, self.made(rows, head))


class TerrasolidReader(RecordReader):
    """Both kinds of records, with times and colours where the file has them."""

    ending = ".bin"
    columns = _PLACE | _STEPS | {"intensity": "int", "return_number": "int", "number_of_returns": "int", "classification": "int", "point_source_id": "int", "gps_time": "double", "red": "int", "green": "int", "blue": "int"}

    def head(self, file: pa.NativeFile) -> dict:
        raw = file.read_at(struct.calcsize(TS_HEADER), 0)
        if len(raw) < struct.calcsize(TS_HEADER):
            raise ValueError("not a Terrasolid file")
        size, version, magic, name, n, units, *origin, time, colour = struct.unpack(TS_HEADER, raw)
        if (size, magic, name) != (len(raw), TS_MAGIC, b"CXYZ") or units < 1:
            raise ValueError("not a Terrasolid file")
        return {"start": size, "type": _ts_type(version == TS_WIDE, bool(time), bool(colour)), "n": n, "wide": version == TS_WIDE, "scale": 1.0 / units, "origin": origin}

    def made(self, rows: np.ndarray, head: dict) -> dict:
        wide = head["wide"]
        echo = np.where(rows["echo"] > 3, 2, rows["echo"]) if wide else rows["echo"] >> 14
        out = {
            "intensity": rows["intensity"] if wide else rows["echo"] & 0x3FFF, "classification": rows["code"], "point_source_id": rows["line"],
            "return_number": _ECHO_RETURN[echo], "number_of_returns": _ECHO_RETURNS[echo],
        }
        for k, a in enumerate("xyz"):
            out[a] = rows[a] * head["scale"] - head["origin"][k] * head["scale"]
            out[f"{a}i"] = _steps(out[a], k)
        if "time" in rows.dtype.names:
            out["gps_time"] = rows["time"] * TS_TICK
        if "colour" in rows.dtype.names:
            out |= {c: rows["colour"][:, k].astype(np.int32) * 256 for k, c in enumerate(("red", "green", "blue"))}
        return out


def _ts_type(wide: bool, time: bool, colour: bool) -> np.dtype:
    return np.dtype([*(_TS_WIDE if wide else _TS_NARROW), *([("time", "<u4")] if time else []), *([("colour", "u1", 4)] if colour else [])])


class QfitReader(RecordReader):
    """x and y are degrees, z metres, so there are no xi, yi and zi: project first. In either byte order."""

    ending = ".qi"
    columns = _PLACE | {"intensity": "int", "scan_angle_rank": "int", "gps_time": "double", "scan_azimuth": "double", "pitch": "double", "roll": "double", "pulse_width": "int"}

    def head(self, file: pa.NativeFile) -> dict:
        raw = file.read_at(64, 0)
        order = next((o for o in "<>" if len(raw) >= 4 and struct.unpack_from(o + "i", raw)[0] in QFIT_SIZES), None)
        if order is None:
            raise ValueError("not a QFIT file")
        size = struct.unpack_from(order + "i", raw)[0]
        start = struct.unpack_from(order + "i", raw, size + 4)[0] if len(raw) >= size + 8 else 0
        if start < size:
            raise ValueError("a QFIT file whose records start within its header")
        return {"start": start, "type": _qfit_type(size, order), "n": max(0, file.size() - start) // size}

    def made(self, rows: np.ndarray, head: dict) -> dict:
        east = rows["longitude"].astype(np.int64)
        azimuth = rows["azimuth"] * 0.001
        rank = azimuth - 180.0
        out = {
            "x": np.where(east > 180_000_000, east - 360_000_000, east) * 0.000001, "y": rows["latitude"] * 0.000001, "z": rows["height"] * 0.001,
            "intensity": rows["intensity"] & 0xFFFF, "scan_angle_rank": np.clip(np.trunc(rank + np.copysign(0.5, rank)), -128, 127), "gps_time": rows["time"] * 0.001,
            "scan_azimuth": azimuth, "pitch": rows["pitch"] * 0.001, "roll": rows["roll"] * 0.001,
        }
        return out | ({"pulse_width": rows["pulse_width"] & 0xFF} if rows.dtype.itemsize == 48 else {})


def _qfit_type(size: int, order: str) -> np.dtype:
    more = ("dilution", "pulse_width", "clock") if size == 48 else tuple(f"more_{k}" for k in range(size // 4 - len(_QFIT)))
    return np.dtype([(n, order + "i4") for n in (*_QFIT, *more)])


class PlyReader(RecordReader):
    """Vertices of binary files in either byte order: properties of any type; those that aren't known are attr_0 to attr_4, in their order. `gray` is an intensity."""

    ending = ".ply"
    columns = _PLACE | _STEPS | {"intensity": "int", "red": "int", "green": "int", "blue": "int", **{f"attr_{k}": "double" for k in range(5)}}

    def head(self, file: pa.NativeFile) -> dict:
        raw, end = b"", -1
        while end < 0:
            more = file.read_at(4096, len(raw))
            if not more or not (raw + more).startswith(b"ply"):
                raise ValueError("not a PLY file")
            raw += more
            end = raw.find(b"end_header")
            end = raw.find(b"\n", end) if end >= 0 else -1
        order, elements = None, []
        for words in (line.split() for line in raw[:end].decode("latin-1").splitlines()):
            if words[:1] == ["format"]:
                order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1])
            elif words[:1] == ["element"]:
                elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                elements[-1][2].append((words[-1], PLY_TYPES.get(words[1])))
        if order is None:
            raise ValueError("a PLY file of text: grids.read_ply_text reads those")
        start = end + 1
        for name, n, properties in elements:
            if any(kind is None for _, kind in properties):
                raise ValueError(f"lists or unknown properties in {name}, before the vertices' end")
            kind = np.dtype([(f"p{k}", order + t) for k, (_, t) in enumerate(properties)])
            if name == "vertex":
                return {"start": start, "type": kind, "n": n, "names": [p for p, _ in properties]}
            start += n * kind.itemsize
        raise ValueError("a PLY file without vertices")

    def made(self, rows: np.ndarray, head: dict) -> dict:
        named = {"gray": "intensity"}
        known, other, out = ("x", "y", "z", "intensity", "red", "green", "blue"), 0, {}
        for k, name in enumerate(head["names"]):
            name, value = named.get(name, name), rows[f"p{k}"]
            if name not in known:
                name, other = f"attr_{other}", other + 1
            if name in known[3:] and value.dtype.kind == "f":
                value = np.clip(np.nan_to_num(value.astype(float), nan=0.0) + 0.5, 0, 65535).astype(np.int32)
            out.setdefault(name, value.astype(float) if name in known[:3] else value)
        return out | {f"{a}i": _steps(out[a], k) for k, a in enumerate("xyz") if a in out}


class DtmReader(DataSourceReader):
    """Filled cells of DTM rasters, a task for about cellsPerPartition cells in whole columns; row 0 is the lowest, x and y are the cells' middles."""

    def __init__(self, options: dict) -> None:
        self.path, self.each = options["path"], int(options.get("cellsPerPartition", 4_000_000))

    def partitions(self) -> list[InputPartition]:
        store, out = _open(self.path)[0], []
        for path in _files(self.path, ".dtm"):
            with store.open_input_file(path) as file:
                raw = file.read_at(200, 0)
                if len(raw) < 200 or not raw.startswith(DTM_NAME[:20]):
                    raise ValueError(f"{path} is not a DTM raster")
                _, _, _, left, low, _, _, turn, dx, dy, cols, rows, _, _, kind, *_ = struct.unpack_from(DTM_HEADER, raw)
                if turn or kind not in range(len(DTM_TYPES)):
                    raise ValueError(f"{path} is turned by {turn}, or of the unknown type {kind}")
                head = {"left": left + dx / 2, "low": low + dy / 2, "dx": dx, "dy": dy, "rows": rows, "type": DTM_TYPES[kind]}
                if 200 + cols * rows * np.dtype(head["type"]).itemsize > file.size():
                    raise ValueError(f"{path} is shorter than its header says")
            step = max(1, self.each // max(1, rows))
            out += [_Part(path, a, min(step, cols - a), head) for a in range(0, cols, step)]
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        h = part.more
        size = h["rows"] * np.dtype(h["type"]).itemsize
        with _open(self.path)[0].open_input_file(part.path) as file:
            for c in range(part.first, part.first + part.count):
                z = np.frombuffer(file.read_at(size, 200 + c * size), h["type"]).astype(float)
                row = np.flatnonzero(~np.isnan(z) & (z != DTM_NONE))
                made = {"col": np.full(len(row), c), "row": row, "x": np.full(len(row), h["left"] + c * h["dx"]), "y": h["low"] + row * h["dy"], "value": z[row]}
                yield _batch(part.path, 0, len(row), DTM_COLUMNS, made)


DTM_COLUMNS = {"source_file": "string", "col": "long", "row": "long", "x": "double", "y": "double", "value": "double"}


def write_dtm(raster: DataFrame, path: str, step: float, rows_per_file: int = 256, cols_per_file: int = 4096) -> DataFrame:
    """Writes a raster (col, row, value) as tiles of 32-bit floats; gives source_file and cells of each. Written when the result is."""

    def tile(cells: np.ndarray, tc: int, tr: int) -> list[tuple[str, bytes]]:
        rows, cols = cells.shape
        filled = cells[cells != DTM_NONE]
        head = struct.pack(DTM_HEADER, DTM_NAME, b"raster", 3.1, tc * cols * step, tr * rows * step, filled.min(), filled.max(), 0.0, step, step, cols, rows, 1, 1, 2, 0, 0, 0, 0)
        return [(".dtm", head.ljust(200, b"\0") + np.ascontiguousarray(cells[::-1].T).tobytes())]

    return write_tiles(raster, path, rows_per_file, cols_per_file, DTM_NONE, tile)


class RecordWriter(FileWriter):
    """Records are held until a file has recordsPerFile of them (1,000,000)."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.each, self.options = int(options.get("recordsPerFile", 1_000_000)), options

    def flag(self, key: str) -> bool:
        return self.options.get(key, "true").lower() == "true"

    def records(self, n: int, get: Callable[..., np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def whole(self, rows: np.ndarray) -> bytes:
        """A file of these records."""
        raise NotImplementedError

    def save_batches(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
        held, n = [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(self.each - n, batch.num_rows - at))
                names = part.schema.names

                def get(name: str, part: pa.RecordBatch = part, names: list[str] = names) -> np.ndarray:
                    if name in names:
                        return pc.fill_null(part.column(name).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                    if name in ("x", "y", "z") and f"{name}i" in names:
                        k = "xyz".index(name)
                        return get(f"{name}i") * DEFAULT_SCALE.scale[k] + DEFAULT_SCALE.offset[k]
                    return np.zeros(part.num_rows)

                held.append(self.records(part.num_rows, get))
                at, n = at + part.num_rows, n + part.num_rows
                if n == self.each:
                    yield [(self.endings[0], self.whole(np.concatenate(held)))]
                    held, n = [], 0
        if n:
            yield [(self.endings[0], self.whole(np.concatenate(held)))]


def _eight_bits(colour: np.ndarray) -> np.ndarray:
    """Values above 255 are of sixteen bits."""
    return np.clip(np.where(colour > 255, colour // 256, colour), 0, 255).astype("u1")


class TerrasolidWriter(RecordWriter):
    """Options: scale (0.01), offset (0,0,0), layout (ts16, or ts8: lines of eight bits, intensities of fourteen), time and colour (true)."""

    endings = (".bin",)

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.wide, self.units = options.get("layout", "ts16") == "ts16", int(round(1 / float(options.get("scale", 0.01))))
        self.origin = [-float(v) * self.units for v in options.get("offset", "0,0,0").split(",")]
        self.type = _ts_type(self.wide, self.flag("time"), self.flag("colour"))

    def records(self, n: int, get: Callable[..., np.ndarray]) -> np.ndarray:
        out = np.zeros(n, self.type)
        for k, a in enumerate("xyz"):
            out[a] = _round(get(a) * self.units + self.origin[k], "i4")
        rn, nr = get("return_number"), get("number_of_returns")
        echo = np.where(nr <= 1, 0, np.where(rn == 1, 1, np.where(rn >= nr, 3, 2)))
        intensity, line = get("intensity").astype(np.int64), get("point_source_id").astype(np.int64)
        out["code"] = get("classification").astype(np.int64) & 255
        if self.wide:
            out["echo"], out["line"], out["intensity"] = echo, line & 0xFFFF, intensity & 0xFFFF
        else:
            out["echo"], out["line"] = echo << 14 | intensity & 0x3FFF, line & 255
        if "time" in self.type.names:
            out["time"] = _round(get("gps_time") / TS_TICK, "u4")
        if "colour" in self.type.names:
            for k, c in enumerate(("red", "green", "blue")):
                out["colour"][:, k] = np.clip(get(c) // 256, 0, 255)
        return out

    def whole(self, rows: np.ndarray) -> bytes:
        head = struct.pack(TS_HEADER, struct.calcsize(TS_HEADER), TS_WIDE if self.wide else TS_NARROW, TS_MAGIC, b"CXYZ", len(rows), self.units, *self.origin, "time" in self.type.names, "colour" in self.type.names)
        return head + rows.tobytes()


class QfitWriter(RecordWriter):
    """x and y in degrees. Options: version (48; 40 has no pulse width). A scan_azimuth that the rows lack is the scan angle's."""

    endings = (".qi",)

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.type = _qfit_type(int(options.get("version", 48)), "<")
        if self.type.itemsize not in QFIT_SIZES:
            raise ValueError(f"QFIT records are of {QFIT_SIZES} bytes")

    def records(self, n: int, get: Callable[..., np.ndarray]) -> np.ndarray:
        out, x, y = np.zeros(n, self.type), get("x"), get("y")
        if n and max(np.abs(x).max(), np.abs(y).max()) >= 361:
            raise ValueError("x and y aren't longitudes and latitudes")
        east = _round(x * 1e6, "i4").astype(np.int64)
        out["longitude"], out["latitude"], out["height"] = np.where(east < 0, east + 360_000_000, east), _round(y * 1e6, "i4"), _round(get("z") * 1e3, "i4")
        out["time"], out["intensity"] = np.abs(_round(get("gps_time") * 1e3, "i4")), get("intensity")
        azimuth = get("scan_azimuth")
        out["azimuth"] = _round(np.where(azimuth == 0, get("scan_angle_rank"), azimuth) * 1e3, "i4")
        out["pitch"], out["roll"] = _round(get("pitch") * 1e3, "i4"), _round(get("roll") * 1e3, "i4")
        if "pulse_width" in self.type.names:
            out["pulse_width"] = get("pulse_width").astype(np.int64) & 255
        return out

    def whole(self, rows: np.ndarray) -> bytes:
        size = self.type.itemsize
        return struct.pack("<i", size).ljust(size, b"\0") + struct.pack("<2i", QFIT_MARK, 2 * size).ljust(size, b"\0") + rows.tobytes()


class PlyWriter(RecordWriter):
    """Binary vertices: x, y, z, intensity and colours of eight bits."""

    endings = (".ply",)

    def records(self, n: int, get: Callable[..., np.ndarray]) -> np.ndarray:
        out = np.zeros(n, _PLY_WRITTEN)
        for name, _ in _PLY_WRITTEN:
            out[name] = _eight_bits(get(name)) if name in ("red", "green", "blue") else get(name)
        return out

    def whole(self, rows: np.ndarray) -> bytes:
        kinds = {"<f8": "double", "<f4": "float", "u1": "uchar"}
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *(f"property {kinds[k]} {n}" for n, k in _PLY_WRITTEN), "end_header"]
        return "".join(line + "\n" for line in lines).encode() + rows.tobytes()


class VrmlWriter(RecordWriter):
    """A set of points as text, in `decimals` (2) places, with colours of 0 to 1 unless `colour` is false."""

    endings = (".wrl",)

    def records(self, n: int, get: Callable[..., np.ndarray]) -> np.ndarray:
        return np.column_stack([*(get(a) for a in "xyz"), *(_eight_bits(get(c)) / 255 for c in ("red", "green", "blue"))])

    def whole(self, rows: np.ndarray) -> bytes:
        d, colour = int(self.options.get("decimals", 2)), self.flag("colour")
        block = lambda name, part, lines: [f"{name} {{", f"{part} [", *lines, "]", "}"]
        look = [] if colour else ["appearance Appearance { material Material { emissiveColor .5 .2 .7 } }"]
        points = block("coord Coordinate", "point", (f"{x:.{d}f} {y:.{d}f} {z:.{d}f}" for x, y, z in rows[:, :3]))
        colours = block("color Color", "color", (f"{r:.2f} {g:.2f} {b:.2f}" for r, g, b in rows[:, 3:])) if colour else []
        return "\n".join(["#VRML V2.0 utf8", "Shape {", *look, "geometry PointSet {", *points, *colours, "}", "}", ""]).encode()


def _source(format_: str, columns: dict[str, str], reader_: type | None, writer_: type | None) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_

        def schema(self) -> str:
            return ", ".join(f"{c} {t}" for c, t in columns.items())

        def reader(self, schema: object) -> DataSourceReader:
            if reader_ is None:
                raise ValueError(f"{format_} files aren't read")
            return reader_(self.options)

        def writer(self, schema: object, overwrite: bool) -> RecordWriter:
            if writer_ is None:
                raise ValueError(f"{format_} files aren't written by a sink")
            return writer_(self.options, overwrite)

    return Source


def register(spark: SparkSession) -> None:
    for name, reader, writer in (("terrasolid", TerrasolidReader, TerrasolidWriter), ("qfit", QfitReader, QfitWriter), ("ply", PlyReader, PlyWriter)):
        spark.dataSource.register(_source(name, reader.columns, reader, writer))
    spark.dataSource.register(_source("dtm", DTM_COLUMNS, DtmReader, None))
    spark.dataSource.register(_source("vrml", _PLACE, None, VrmlWriter))
