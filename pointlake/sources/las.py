"""LAS files (1.0 to 1.4, uncompressed): a partitioned reader, a table of headers, and a writer, as Spark data sources.

Every file has its own scaling. All operators count in one (`schema.DEFAULT_SCALE`), so the reader
brings xi, yi and zi to it, whatever mixture of scales and offsets a folder holds; x, y and z keep
the file's own precision, and with the option `scaling` each row brings its file's scale and offset.

The driver looks at headers only, leaves out files whose box doesn't meet the bounds, and cuts the
others' records into ranges, so a large file is read by many tasks. Bounds are those of the
option `inside` and those that Spark pushes down: comparisons of x, y and z with constants. A
task then reads, of files that have an index beside them (`write_index`), only the ranges of
records whose cells meet the bounds. Records are decoded by one numpy view a range. Files are
opened through pyarrow's file systems, so the path may be any that those know. Register all with
`register(spark)`, then spark.read.format("las").load(path), df.write.format("las").save(dir).
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from pointlake.operators.index import Quadtree, limit_intervals
from pointlake.operators.spatial import index_intervals
from pointlake.schema import DEFAULT_SCALE

#: The size of each record format without extra bytes.
RECORD_SIZES = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
#: Which formats hold time, colour, near infrared, a wave packet, the fields of 1.4.
WITH_TIME = (1, 3, 4, 5, 6, 7, 8, 9, 10)
WITH_COLOUR = (2, 3, 5, 7, 8, 10)
WITH_NIR = (8, 10)
WITH_WAVE = (4, 5, 9, 10)
EXTENDED = (6, 7, 8, 9, 10)
#: Types of extra attributes, by their number.
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
#: The attributes that hold what formats below 6 can't.
COMPATIBLE = (
    ("LAS 1.4 scan angle", 4), ("LAS 1.4 extended returns", 1), ("LAS 1.4 classification", 1),
    ("LAS 1.4 flags and channel", 1), ("LAS 1.4 NIR band", 3),
)
#: Fixed value: degrees a step of an extended scan angle.
ANGLE_STEP = 0.006
ATTRIBUTES = 5

COLUMNS = {
    "source_file": "string", "point_index": "long", "xi": "int", "yi": "int", "zi": "int", "x": "double", "y": "double", "z": "double",
    "intensity": "int", "return_number": "int", "number_of_returns": "int", "scan_direction_flag": "int", "edge_of_flight_line": "int",
    "classification": "int", "synthetic_flag": "int", "keypoint_flag": "int", "withheld_flag": "int", "overlap_flag": "int",
    "scanner_channel": "int", "ext_classification": "int", "ext_return_number": "int", "ext_number_of_returns": "int",
    "scan_angle_rank": "int", "scan_angle": "double", "user_data": "int", "point_source_id": "int", "gps_time": "double",
    "red": "int", "green": "int", "blue": "int", "nir": "int", "wave_index": "int", "wave_offset": "long", "wave_size": "int",
    "wave_location": "double", "wave_xt": "double", "wave_yt": "double", "wave_zt": "double",
    **{f"attr_{k}": "double" for k in range(ATTRIBUTES)},
}
SCALING = {f"{kind}_{a}": "double" for kind in ("scale", "offset") for a in "xyz"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


@dataclass(frozen=True)
class Attribute:
    """An extra attribute of a record: its value is stored * scale + shift, and null where it equals none."""

    name: str
    type: int
    at: int
    scale: float = 1.0
    shift: float = 0.0
    none: float | None = None

    @property
    def field(self) -> str:
        """The record's field: attributes may be named like fields of the format, or like each other."""
        return self.name if self.name in dict(COMPATIBLE) else f"extra {self.at}"

    def values(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        value = raw.astype(float) * self.scale + self.shift
        return value, None if self.none is None else raw == raw.dtype.type(self.none)

    def stored(self, value: np.ndarray, no: np.ndarray) -> np.ndarray:
        """What a record holds of values: whole numbers nearest to them; nulls are the no-data value, or zero as it's stored where there is none."""
        kind = np.dtype(EXTRA_TYPES[self.type])
        raw = np.where(no, 0.0 if self.none is None else self.none, (value - self.shift) / self.scale)
        if kind.kind == "f":
            return raw.astype(kind)
        raw, limits = np.rint(raw), np.iinfo(kind)
        if len(raw) and not (limits.min <= raw.min() and raw.max() <= limits.max):
            raise ValueError(f"{self.name}: values don't fit into its type")
        return raw.astype(kind)


def added_attribute(spec: str) -> tuple[str, Attribute]:
    """The column and the attribute of column=name[:type[:scale[:shift[:none]]]]; a type is its number in `EXTRA_TYPES`, by default doubles."""
    column, described = spec.split("=", 1)
    name, kind, scale, shift, none = [*described.split(":"), *[""] * 4][:5]
    if int(kind or 10) not in EXTRA_TYPES or float(scale or 1) == 0:
        raise ValueError(f"no type of attributes, or a scale of zero: {spec}")
    return column.strip(), Attribute(name, int(kind or 10), 0, float(scale or 1), float(shift or 0), float(none) if none else None)


def record_type(format_: int, size: int, extra: tuple[Attribute, ...] = ()) -> np.dtype:
    """The numpy type of a record; what is behind the known fields is skipped."""
    fields: list[tuple] = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
    if format_ in EXTENDED:
        fields += [("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
    else:
        fields += [("returns", "u1"), ("classification", "u1"), ("angle", "i1"), ("user_data", "u1"), ("source", "<u2")]
        fields += [("time", "<f8")] * (format_ in WITH_TIME)
    fields += [(c, "<u2") for c in ("red", "green", "blue")] * (format_ in WITH_COLOUR)
    fields += [("nir", "<u2")] * (format_ in WITH_NIR)
    if format_ in WITH_WAVE:
        fields += [("wave_index", "u1"), ("wave_offset", "<u8"), ("wave_size", "<u4"), ("wave_location", "<f4"), ("wave_xt", "<f4"), ("wave_yt", "<f4"), ("wave_zt", "<f4")]
    known = np.dtype(fields)
    names = [*known.names, *(a.field for a in extra)]
    types = [*(known.fields[n][0] for n in known.names), *(np.dtype(EXTRA_TYPES[a.type]) for a in extra)]
    places = [*(known.fields[n][1] for n in known.names), *(RECORD_SIZES[format_] + a.at for a in extra)]
    return np.dtype({"names": names, "formats": types, "offsets": places, "itemsize": size})


def read_header(raw: bytes) -> dict:
    """The parts of a header that reading needs."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    if raw[104] & 0x80:
        raise ValueError("compressed points are not read")
    n = lambda at, kind, count=1: np.frombuffer(raw, kind, count, at).tolist()
    head = {"minor": raw[25], "header_size": n(94, "<u2")[0], "offset": n(96, "<u4")[0], "vlrs": n(100, "<u4")[0], "format": raw[104] & 0x3F}
    head |= {"size": n(105, "<u2")[0], "points": n(107, "<u4")[0], "by_return": n(111, "<u4", 5)}
    head |= {"scale": n(131, "<f8", 3), "shift": n(155, "<f8", 3)}
    head |= dict(zip(("max_x", "min_x", "max_y", "min_y", "max_z", "min_z"), n(179, "<f8", 6), strict=True))
    if head["minor"] >= 4 and len(raw) >= 375:
        head["points"] = n(247, "<u8")[0] or head["points"]
        head["by_return"] = n(255, "<u8", 15) if any(n(255, "<u8", 15)) else head["by_return"]
        head |= {"evlr_at": n(235, "<u8")[0], "evlrs": n(243, "<u4")[0]}
    head["wave_start"] = n(227, "<u8")[0] if head["minor"] >= 3 and len(raw) >= 235 else 0
    if head["format"] >= len(RECORD_SIZES) or head["size"] < RECORD_SIZES[head["format"]]:
        raise ValueError(f"records of format {head['format']} with {head['size']} bytes are not known")
    return head


def read_records(file: pa.NativeFile, head: dict) -> list[tuple[str, int, bytes]]:
    """user_id, record_id and data of the variable records before and behind the points."""
    out, at = [], head["header_size"]
    for k in range(head["vlrs"] + head.get("evlrs", 0)):
        wide = k >= head["vlrs"]
        at = head["evlr_at"] if k == head["vlrs"] else at
        intro = file.read_at(60 if wide else 54, at)
        if len(intro) < (60 if wide else 54):
            break
        user, number = intro[2:18].split(b"\0")[0].decode("latin-1"), struct.unpack_from("<H", intro, 18)[0]
        size = struct.unpack_from("<Q" if wide else "<H", intro, 20)[0]
        out.append((user, number, file.read_at(size, at + len(intro))))
        at += len(intro) + size
    return out


def attributes(records: list[tuple[str, int, bytes]], room: int) -> tuple[Attribute, ...]:
    """The extra attributes that a file describes; those that don't fit into the record's extra bytes are left out."""
    out, at = [], 0
    for user, number, data in records:
        if (user, number) != ("LASF_Spec", 4):
            continue
        for d in (data[i : i + 192] for i in range(0, len(data) - 191, 192)):
            kind, options = d[2], d[3]
            if kind not in EXTRA_TYPES:
                at += options if kind == 0 else 0  # undocumented bytes
                continue
            size, code = np.dtype(EXTRA_TYPES[kind]).itemsize, EXTRA_TYPES[kind][-2:-1]
            none = struct.unpack_from("<d" if code == "f" else "<q" if code == "i" else "<Q", d, 40)[0]
            scale, shift = struct.unpack_from("<d", d, 112)[0], struct.unpack_from("<d", d, 136)[0]
            if at + size <= room:
                out.append(Attribute(d[4:36].split(b"\0")[0].decode("latin-1"), kind, at, scale if options & 8 else 1.0, shift if options & 16 else 0.0, none if options & 1 else None))
            at += size
    return tuple(out)


def _raw(value: np.ndarray, scale: float, shift: float) -> np.ndarray:
    """Coordinates in steps of scale from shift, halves away from it, as `schema.ScaleOffset.raw` has them."""
    steps = (value - shift) / scale
    steps = np.where(value >= shift, np.floor(steps + 0.5), np.ceil(steps - 0.5))
    if len(steps) and np.abs(steps).max() > 2**31 - 1:
        raise ValueError(f"a coordinate doesn't fit into 32 bits at scale {scale} and offset {shift}")
    return steps.astype(np.int32)


def decode(raw: bytes, head: dict, path: str, first: int, columns: Iterable[str] = COLUMNS) -> pa.RecordBatch:
    """Records as columns of `COLUMNS` and `SCALING`; only those asked for are made."""
    r = np.frombuffer(raw, record_type(head["format"], head["size"], head.get("extra", ())))
    ext, names = head["format"] in EXTENDED, r.dtype.names
    extra = {a.name: a for a in head.get("extra", ())}
    returns, cls = r["returns"].astype(np.int32), r["classification"].astype(np.int32)
    if ext:
        flags = r["flags"].astype(np.int32)
        rn, nr, full, angle = returns & 15, returns >> 4, cls, r["angle"] * ANGLE_STEP
        bits = {"synthetic_flag": flags & 1, "keypoint_flag": flags >> 1 & 1, "withheld_flag": flags >> 2 & 1, "overlap_flag": flags >> 3 & 1,
                "scanner_channel": flags >> 4 & 3, "scan_direction_flag": flags >> 6 & 1, "edge_of_flight_line": flags >> 7}
        legacy, rank = np.where(cls <= 31, cls, 0), np.clip(np.rint(angle), -128, 127).astype(np.int32)
        legacy_rn, legacy_nr = _legacy_returns(rn, nr)
    else:
        rn, nr, legacy = returns & 7, returns >> 3 & 7, cls & 31
        zero, rank = np.zeros(len(r), np.int32), r["angle"].astype(np.int32)
        bits = {"synthetic_flag": cls >> 5 & 1, "keypoint_flag": cls >> 6 & 1, "withheld_flag": cls >> 7, "overlap_flag": zero,
                "scanner_channel": zero, "scan_direction_flag": returns >> 6 & 1, "edge_of_flight_line": returns >> 7}
        full, angle, legacy_rn, legacy_nr = legacy, rank.astype(float), rn, nr
        if COMPATIBLE[0][0] in extra:  # extended fields were put into extra bytes
            more = {n: r[n].astype(np.int32) for n, _ in COMPATIBLE[:4]}
            steps, both, far = (more[COMPATIBLE[k][0]] for k in range(3))
            angle = (np.rint(rank / ANGLE_STEP) + steps) * ANGLE_STEP
            rn, nr, full = rn + (both >> 4), nr + (both & 15), np.where(far > 0, far, legacy)
            bits |= {"overlap_flag": more[COMPATIBLE[3][0]] & 1, "scanner_channel": more[COMPATIBLE[3][0]] >> 1 & 3}
    make = {"source_file": lambda: pa.array([path]).take(pa.array(np.zeros(len(r), np.int32))), "point_index": lambda: np.arange(first, first + len(r))}
    for k, a in enumerate("xyz"):
        x, scale, shift = r[a.upper()], head["scale"][k], head["shift"][k]
        own = (scale, shift) == (DEFAULT_SCALE.scale[k], DEFAULT_SCALE.offset[k])
        make[f"{a}i"] = lambda x=x, scale=scale, shift=shift, own=own, k=k: x if own else _raw(x * scale + shift, DEFAULT_SCALE.scale[k], DEFAULT_SCALE.offset[k])
        make[a] = lambda x=x, scale=scale, shift=shift: x * scale + shift
        make[f"scale_{a}"] = lambda scale=scale: np.full(len(r), scale)
        make[f"offset_{a}"] = lambda shift=shift: np.full(len(r), shift)
    make |= {n: lambda v=v: v for n, v in bits.items()}
    make |= {"return_number": lambda: legacy_rn, "number_of_returns": lambda: legacy_nr, "ext_return_number": lambda: rn, "ext_number_of_returns": lambda: nr}
    make |= {"classification": lambda: legacy, "ext_classification": lambda: full, "scan_angle_rank": lambda: rank, "scan_angle": lambda: angle}
    make |= {"intensity": lambda: r["intensity"], "user_data": lambda: r["user_data"], "point_source_id": lambda: r["source"]}
    stored = {"gps_time": "time"} | {c: c for c in ("red", "green", "blue", "nir", "wave_index", "wave_offset", "wave_size", "wave_location", "wave_xt", "wave_yt", "wave_zt")}
    stored["nir"] = "nir" if "nir" in names else COMPATIBLE[4][0]
    make |= {c: lambda n=n: r[n] if n in names else None for c, n in stored.items()}
    own = [a for a in head.get("extra", ()) if a.name not in dict(COMPATIBLE)][:ATTRIBUTES]
    make |= {f"attr_{k}": lambda a=a: a.values(r[a.field]) for k, a in enumerate(own)}
    arrays, kinds = [], COLUMNS | SCALING
    for c in columns:
        value, kind = make.get(c, lambda: None)(), _ARROW[kinds[c]]
        if value is None:
            arrays.append(pa.nulls(len(r), kind))
        elif isinstance(value, tuple):
            arrays.append(pa.array(value[0], kind, mask=value[1]))
        else:
            arrays.append(value if isinstance(value, pa.Array) else pa.array(np.ascontiguousarray(value).astype(kind.to_pandas_dtype(), copy=False)))
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _legacy_returns(rn: np.ndarray, nr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return numbers that three bits hold: the last return stays the last, and no other becomes it."""
    few = np.minimum(nr, 7)
    return np.where(nr > 7, np.where(rn >= nr, 7, np.minimum(rn, 6)), np.minimum(rn, 7)), few


@dataclass
class _Range(InputPartition):
    path: str
    head: dict
    first: int
    count: int


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str, listed: str = "") -> list[str]:
    store, path = _open(path)
    info = store.get_file_info(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
    files = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".las"))
    if listed:  # a text file of names below the path, one a line; a repeated one counts once
        with store.open_input_file(_open(listed)[1]) as names:
            wanted = {n.strip() for n in names.read().decode().splitlines()}
        files = [f for f in files if f in wanted or f.removeprefix(path).lstrip("/") in wanted]
    return files


def _head_of(store: fs.FileSystem, file: str) -> dict:
    with store.open_input_file(file) as opened:
        head = read_header(opened.read(375))
        head["records"] = read_records(opened, head) if head["vlrs"] or head.get("evlrs") else []
    head["extra"] = attributes(head["records"], head["size"] - RECORD_SIZES[head["format"]])
    head["waves"] = wave_descriptors(head["records"])
    return head


class LasReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str] | None = None) -> None:
        self.path, self.each = options["path"], int(options.get("recordsPerPartition", 1_000_000))
        self.listed, self.columns = options.get("listed", ""), columns or list(COLUMNS)
        self.low, self.high = dict.fromkeys("xyz", -np.inf), dict.fromkeys("xyz", np.inf)
        if inside := options.get("inside", ""):  # min_x,min_y,max_x,max_y
            self.low["x"], self.low["y"], self.high["x"], self.high["y"] = (float(v) for v in inside.split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of x, y and z with constants bound what is read; Spark applies all filters to what comes."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("x",), ("y",), ("z",)) and f.value is not None:
                axis, value = f.attribute[0], float(f.value)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[axis] = max(self.low[axis], value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[axis] = min(self.high[axis], value)
            yield f

    def partitions(self) -> list[InputPartition]:
        store, _ = _open(self.path)
        files = _listed(self.path, self.listed)
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(lambda f: _head_of(store, f), files))
        return [
            _Range(f, {k: v for k, v in head.items() if k != "records"}, a, min(self.each, head["points"] - a))
            for f, head in zip(files, heads, strict=True) if self.meets(head) for a in range(0, head["points"], self.each)
        ]

    def meets(self, box: dict) -> bool:
        """Whether a box meets the bounds."""
        return all(box.get(f"min_{a}", -np.inf) <= self.high[a] and box.get(f"max_{a}", np.inf) >= self.low[a] for a in "xyz")

    def ranges(self, partition: _Range) -> list[tuple[int, int]]:
        """(first, count) of the partition's records that are to be read: with an index beside the file those of cells that meet the bounds."""
        whole = [(partition.first, partition.count)]
        store, path = _open(self.path)[0], index_path(partition.path)
        if not (np.isfinite([*self.low.values(), *self.high.values()]).any() and store.get_file_info(path).is_file):
            return whole
        with store.open_input_file(path) as file:
            cells = pq.read_table(file).to_pandas()
        on = (cells["first"] < partition.first + partition.count) & (cells["last"] >= partition.first)
        for a in "xy":
            on &= (cells[f"min_{a}"] <= self.high[a]) & (cells[f"max_{a}"] >= self.low[a])
        out: list[list[int]] = []
        for a, b in cells[on].sort_values("first")[["first", "last"]].itertuples(index=False, name=None):
            a, b = max(a, partition.first), min(b, partition.first + partition.count - 1)
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(int(a), int(b - a + 1)) for a, b in out]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file meets the bounds
            return
        store, _ = _open(self.path)
        size, step = partition.head["size"], 100_000
        with store.open_input_file(partition.path) as file:
            for first, count in self.ranges(partition):
                for a in range(first, first + count, step):
                    n = min(step, first + count - a)
                    raw = file.read_at(n * size, partition.head["offset"] + a * size)
                    if len(raw) < n * size:
                        raise ValueError(f"{partition.path} ends before its last record")
                    yield decode(raw, partition.head, partition.path, a, self.columns)


WAVEFORMS = "source_file string, point_index long, wave_index int, spacing double, samples array<double>, x double, y double, z double, step_x double, step_y double, step_z double"


def wave_descriptors(records: list[tuple[str, int, bytes]]) -> dict[int, tuple[int, int, int, float, float]]:
    """By index: bits a sample, number of samples, picoseconds between them, gain and offset of the digitiser; packed ones are left out."""
    out = {}
    for user, number, data in records:
        if user == "LASF_Spec" and 100 <= number < 355 and len(data) >= 26:
            bits, packed, count, spacing, gain, offset = struct.unpack_from("<BBIIdd", data)
            if not packed and bits in (8, 16):
                out[number - 99] = (bits, count, spacing, gain, offset)
    return out


class WaveReader(LasReader):
    """The waveforms of points: samples in volts, the place of the first one, and the way from one to the next.

    Packets lie in a second file (.wdp), or behind the points, at the points' own offsets. Those of a
    stretch of points are read in the order of their offsets, neighbours with one request. Points
    without a packet, or with one whose descriptor is missing or packed, have no row.
    """

    GAP, MOST = 1 << 16, 1 << 24  # bytes read over, and at once

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, head = _open(self.path)[0], partition.head
        if head["format"] not in WITH_WAVE or not head["waves"]:
            return
        beside = re.sub(r"(?i)\.las$", ".wdp", partition.path)
        outside = store.get_file_info(beside).is_file
        start = 0 if outside else head["wave_start"]
        columns = ["source_file", "point_index", "wave_index", "wave_offset", "wave_size", "wave_location", "wave_xt", "wave_yt", "wave_zt", "x", "y", "z"]
        with store.open_input_file(partition.path) as points, store.open_input_file(beside if outside else partition.path) as waves:
            for a in range(partition.first, partition.first + partition.count, 20_000):
                n = min(20_000, partition.first + partition.count - a)
                raw = points.read_at(n * head["size"], head["offset"] + a * head["size"])
                yield from self.waves(decode(raw, head, partition.path, a, columns).to_pandas(), head["waves"], waves, start)

    def waves(self, rows: pd.DataFrame, descriptors: dict, file: pa.NativeFile, start: int) -> Iterator[pa.RecordBatch]:
        rows = rows[rows["wave_index"].isin(list(descriptors))].sort_values("wave_offset")
        size = rows["wave_index"].map(lambda k: descriptors[k][1] * descriptors[k][0] // 8).to_numpy(np.int64)
        at = rows["wave_offset"].to_numpy(np.int64) + start
        i = 0
        while i < len(rows):
            j, end = i + 1, at[i] + size[i]
            while j < len(rows) and at[j] <= end + self.GAP and at[j] + size[j] - at[i] <= self.MOST:
                end, j = max(end, at[j] + size[j]), j + 1
            data = file.read_at(int(end - at[i]), int(at[i]))
            yield self.batch(rows.iloc[i:j], [data[b - at[i] : b - at[i] + n] for b, n in zip(at[i:j], size[i:j], strict=True)], descriptors)
            i = j

    @staticmethod
    def batch(rows: pd.DataFrame, packets: list[bytes], descriptors: dict) -> pa.RecordBatch:
        samples, spacing = [], []
        for k, raw in zip(rows["wave_index"], packets, strict=True):
            bits, count, gap, gain, offset = descriptors[k]
            if len(raw) < count * bits // 8:
                raise ValueError("a waveform packet ends before its last sample")
            samples.append(np.frombuffer(raw, "u1" if bits == 8 else "<u2", count) * gain + offset)
            spacing.append(float(gap))
        spacing = np.array(spacing)
        out = {"source_file": rows["source_file"], "point_index": rows["point_index"], "wave_index": rows["wave_index"], "spacing": spacing, "samples": samples}
        for a in "xyz":
            along = rows[f"wave_{a}t"].to_numpy()  # metres a picosecond, towards the sensor: a later sample lies further back
            out[a] = rows[a].to_numpy() + rows["wave_location"].to_numpy() * along
            out[f"step_{a}"] = -spacing * along
        names = [c.split()[0] for c in WAVEFORMS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), *[pa.float64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names)


HEADERS = (
    "source_file string, version string, format int, record_size int, points long, scale array<double>, offset array<double>, min_x double, min_y double, "
    "min_z double, max_x double, max_y double, max_z double, by_return array<long>, attributes array<string>, "
    "records array<struct<user_id: string, record_id: int, data: binary>>"
)


class HeaderReader(DataSourceReader):
    """A row a file; files are dealt to tasks, which open them."""

    def __init__(self, options: dict) -> None:
        self.path, self.listed, self.each = options["path"], options.get("listed", ""), int(options.get("filesPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        files = _listed(self.path, self.listed)
        return [_Files(files[i : i + self.each]) for i in range(0, len(files), self.each)]

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for f in partition.paths if partition else []:
            h = _head_of(store, f)
            box = [h[f"{m}_{a}"] for m in ("min", "max") for a in "xyz"]
            yield (f, f"1.{h['minor']}", h["format"], h["size"], h["points"], h["scale"], h["shift"], *box, h["by_return"], [a.name for a in h["extra"]], h["records"])


def index_path(file: str) -> str:
    return re.sub(r"(?i)\.las$", "", file) + ".ranges"


def write_index(spark: SparkSession, path: str, cell: float, most: int = 1000) -> None:
    """Writes an index beside each file below path: for each cell the runs of its records, at most `most` a file (and one a cell).

    A file's runs are written by one task; readers need them only where they have bounds.
    """
    points = spark.read.format("las").option("columns", "source_file,point_index,xi,yi,x,y").load(path)
    tree = Quadtree.of(points, cell)
    runs = index_intervals(tree.indexed(points).withColumnRenamed("cell_code", "cell_index"))
    runs = limit_intervals(runs, most)
    # a cell's edge belongs to its neighbour after rounding, so boxes are wider by a step
    pad = max(DEFAULT_SCALE.scale)
    box = {n.removeprefix("cell_"): v - pad if "min" in n else v + pad for n, v in tree.box(F.col("cell_index")).items()}
    rows = runs.select("source_file", "first", "last", *[v.alias(n) for n, v in box.items()])

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        file = frame["source_file"].iloc[0]
        store, _ = _open(path)
        out = io.BytesIO()
        pq.write_table(pa.Table.from_pandas(frame.drop(columns="source_file").sort_values("first"), preserve_index=False), out)
        with store.open_output_stream(index_path(file)) as stream:
            stream.write(out.getvalue())
        return pd.DataFrame({"source_file": [file], "runs": [len(frame)]})

    rows.groupBy("source_file").applyInPandas(write, "source_file string, runs long").agg(F.sum("runs")).collect()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # waiting and final names


class LasWriter(DataSourceArrowWriter):
    """Files of at most recordsPerFile records, written aside and moved to their names when the job commits; with overwrite the old files go then.

    Options: scale and offset of the files (the library's own by default), inScale and inOffset of
    the rows' xi, yi and zi; pointFormat (0 to 10; from 6 on the version is 1.4, else 1.2);
    compatible: a format from 6 on is written as the one of 1.2 that has the same fields, what that
    can't hold in extra bytes; extra: attributes to write, such as attr_0=height,attr_1=range:4:0.01:0:-1
    (`added_attribute`). In
    formats with waves a column `samples` (array of 0 ... 65535) is written as 16-bit packets into a
    file beside the points, `spacing` picoseconds apart; points without samples have no packet.
    """

    def __init__(self, options: dict, overwrite: bool = False) -> None:
        three = lambda key, default: [float(s) for s in options[key].split(",")] if key in options else list(default)
        self.path, self.overwrite, self.each = options["path"], overwrite, int(options.get("recordsPerFile", 1_000_000))
        self.scale, self.shift = three("scale", DEFAULT_SCALE.scale), three("offset", DEFAULT_SCALE.offset)
        self.in_scale, self.in_shift = three("inScale", DEFAULT_SCALE.scale), three("inOffset", DEFAULT_SCALE.offset)
        self.spacing = int(options.get("spacing", 1000))
        self.format, self.compatible = int(options.get("pointFormat", 3)), options.get("compatible", "false").lower() == "true"
        named = [added_attribute(spec) for spec in options.get("extra", "").split(",") if spec]
        extra = [a for _, a in named]
        if self.compatible:
            #: Formats of 1.2 with the fields of those of 1.4.
            self.format, infrared = {6: 1, 7: 3, 8: 3, 9: 4, 10: 5}[self.format], self.format in WITH_NIR
            own = [Attribute(n, kind, 0, ANGLE_STEP if n == COMPATIBLE[0][0] else 1.0) for n, kind in COMPATIBLE[: 5 if infrared else 4]]
            extra = [*own, *extra]
        at, self.extra = 0, []
        for a in extra:
            self.extra.append(replace(a, at=at))
            at += np.dtype(EXTRA_TYPES[a.type]).itemsize
        self.columns_of = {a.field: c for (c, _), a in zip(named, self.extra[len(extra) - len(named) :], strict=True)}
        self.type = record_type(self.format, RECORD_SIZES[self.format] + at, tuple(self.extra))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file's records are held until their number and box are known, never the partition's."""
        out, rows, waves, n = _Written(), [], [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(self.each - n, batch.num_rows - at))
                rows.append(self.records(part))
                if self.format in WITH_WAVE and "samples" in part.schema.names:
                    waves += [None if v is None else np.array(v, "<u2") for v in part.column("samples").to_pylist()]
                at, n = at + part.num_rows, n + part.num_rows
                if n == self.each:
                    out.files += self.save(np.concatenate(rows), waves)
                    rows, waves, n = [], [], 0
        if n:
            out.files += self.save(np.concatenate(rows), waves)
        return out

    def save(self, rows: np.ndarray, waves: list[np.ndarray | None]) -> list[tuple[str, str]]:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        name, lengths, files = uuid.uuid4().hex, [], []
        if waves:
            lengths = sorted({len(w) for w in waves if w is not None})
            if len(lengths) > 255:
                raise ValueError("waveforms of more than 255 lengths in one file")
            size = np.array([0 if w is None else 2 * len(w) for w in waves])
            rows["wave_index"] = [0 if w is None else lengths.index(len(w)) + 1 for w in waves]
            rows["wave_offset"], rows["wave_size"] = np.cumsum(size) - size + 60, size  # behind the record's own header
            with store.open_output_stream(f"{path}/_{name}.wdp.waiting") as out:
                out.write(struct.pack("<H16sHQ32s", 0, b"LASF_Spec", 65535, int(size.sum()), b"waveform packets"))
                for w in waves:
                    out.write(b"" if w is None else w.tobytes())
            files.append((f"{path}/_{name}.wdp.waiting", f"{path}/part-{name}.wdp"))
        with store.open_output_stream(f"{path}/_{name}.waiting") as out:
            out.write(self.header(rows, lengths))
            out.write(rows.tobytes())
        return [*files, (f"{path}/_{name}.waiting", f"{path}/part-{name}.las")]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _open(self.path)
        old = _listed(self.path) if self.overwrite and store.get_file_info(path).type == fs.FileType.Directory else []
        for waiting, final in (f for m in messages if m is not None for f in m.files):
            store.move(waiting, final)
        for file in old:
            store.delete_file(file)
            for beside in (index_path(file), re.sub(r"(?i)\.las$", ".wdp", file)):
                if store.get_file_info(beside).is_file:
                    store.delete_file(beside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _open(self.path)
        for waiting, _final in (f for m in messages if m is not None for f in m.files):
            store.delete_file(waiting)

    def records(self, batch: pa.RecordBatch) -> np.ndarray:
        """Records of a batch; columns that it lacks, and nulls, are zero."""
        names, out = batch.schema.names, np.zeros(batch.num_rows, self.type)

        def get(*columns: str, kind: type = np.int64) -> np.ndarray:
            """The first of the columns that the rows have."""
            for name in columns:
                if name in names:
                    return pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False).astype(kind)
            return np.zeros(len(out), kind)

        for k, a in enumerate("xyz"):
            raw, own = get(f"{a}i"), (self.in_scale[k], self.in_shift[k]) == (self.scale[k], self.shift[k])
            out[a.upper()] = raw if own else _raw(raw * self.in_scale[k] + self.in_shift[k], self.scale[k], self.shift[k])
        for name in ("intensity", "user_data", "red", "green", "blue", "nir", "wave_index", "wave_offset", "wave_size"):
            if name in self.type.names:
                out[name] = get(name).astype(self.type[name])
        for name in ("wave_location", "wave_xt", "wave_yt", "wave_zt"):
            if name in self.type.names:
                out[name] = get(name, kind=float)
        out["source"] = get("point_source_id").astype("<u2")
        if "time" in self.type.names:
            out["time"] = get("gps_time", kind=float)
        for a in self.extra:
            if a.field in self.columns_of:
                column = self.columns_of[a.field]
                no = pc.is_null(batch.column(column)).to_numpy(zero_copy_only=False) if column in names else np.ones(len(out), bool)
                out[a.field] = a.stored(get(column, kind=float), no)
        bits = {n: get(n) & 1 for n in ("scan_direction_flag", "edge_of_flight_line", "synthetic_flag", "keypoint_flag", "withheld_flag", "overlap_flag")}
        rn, nr, full = get("ext_return_number", "return_number"), get("ext_number_of_returns", "number_of_returns"), get("ext_classification", "classification") & 255
        steps = np.rint(get("scan_angle", "scan_angle_rank", kind=float) / ANGLE_STEP).astype(np.int64)
        channel = get("scanner_channel") & 3
        if self.format in EXTENDED:
            out["returns"], out["classification"], out["angle"] = rn & 15 | (nr & 15) << 4, full, np.clip(steps, -30_000, 30_000)
            out["flags"] = bits["synthetic_flag"] | bits["keypoint_flag"] << 1 | bits["withheld_flag"] << 2 | bits["overlap_flag"] << 3 | channel << 4
            out["flags"] |= (bits["scan_direction_flag"] << 6 | bits["edge_of_flight_line"] << 7).astype(np.uint8)
            return out
        few_rn, few_nr, legacy, rank = get("return_number"), get("number_of_returns"), get("classification"), get("scan_angle_rank")
        if self.compatible:
            few_rn, few_nr = _legacy_returns(rn, nr)
            legacy, rank = np.where(full <= 31, full, 0), np.clip(np.rint(steps * ANGLE_STEP), -128, 127).astype(np.int64)
            out[COMPATIBLE[0][0]] = steps - np.rint(rank / ANGLE_STEP)
            out[COMPATIBLE[1][0]] = rn - few_rn << 4 | nr - few_nr
            out[COMPATIBLE[2][0]] = np.where(full > 31, full, 0)
            out[COMPATIBLE[3][0]] = bits["overlap_flag"] | channel << 1
            if COMPATIBLE[4][0] in self.type.names:
                out[COMPATIBLE[4][0]] = get("nir").astype(np.uint16)
        out["angle"] = np.clip(rank, -128, 127)
        out["returns"] = few_rn & 7 | (few_nr & 7) << 3 | bits["scan_direction_flag"] << 6 | bits["edge_of_flight_line"] << 7
        out["classification"] = legacy & 31 | bits["synthetic_flag"] << 5 | bits["keypoint_flag"] << 6 | bits["withheld_flag"] << 7
        return out

    def header(self, rows: np.ndarray, lengths: list[int] = []) -> bytes:  # noqa: B006
        """The header of a file with these records, and the records that describe its extra attributes and waveforms."""
        ext = self.format in EXTENDED
        size = 375 if ext else 235 if self.format in WITH_WAVE else 227
        described = b"".join(self.describe(a) for a in self.extra)
        records = [struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"extra bytes") + described] if described else []
        for k, count in enumerate(lengths):
            records.append(struct.pack("<H16sHH32sBBIIdd", 0, b"LASF_Spec", 100 + k, 26, b"waveform packet", 16, 0, count, self.spacing, 1.0, 0.0))
        raw = bytearray(size)
        raw[:4], raw[24:26] = b"LASF", bytes([1, 4 if ext else 3 if self.format in WITH_WAVE else 2])
        put = lambda at, kind, *v: raw.__setitem__(slice(at, at + np.dtype(kind).itemsize * len(v)), np.array(v, kind).tobytes())
        put(94, "<u2", size)
        put(96, "<u4", size + sum(map(len, records)))
        put(100, "<u4", len(records))
        raw[104] = self.format
        put(105, "<u2", self.type.itemsize)
        by_return = np.bincount(rows["returns"] & (15 if ext else 7), minlength=16)[1:]
        if ext:
            put(247, "<u8", len(rows))
            put(255, "<u8", *by_return[:15])
        else:
            put(107, "<u4", len(rows))
            put(111, "<u4", *by_return[:5])
        put(131, "<f8", *self.scale)
        put(155, "<f8", *self.shift)
        box = [f(rows[a]) * self.scale[k] + self.shift[k] for k, a in enumerate("XYZ") for f in (np.max, np.min)]
        put(179, "<f8", *box)
        return bytes(raw) + b"".join(records)

    @staticmethod
    def describe(a: Attribute) -> bytes:
        raw = bytearray(192)
        raw[2], raw[3] = a.type, (a.none is not None) + 8 * (a.scale != 1.0) + 16 * (a.shift != 0.0)
        raw[4:36] = a.name.encode("latin-1", "replace")[:32].ljust(32, b"\0")
        if a.none is not None:
            code = EXTRA_TYPES[a.type][-2:-1]
            struct.pack_into("<d" if code == "f" else "<q" if code == "i" else "<Q", raw, 40, a.none if code == "f" else int(a.none))
        struct.pack_into("<d", raw, 112, a.scale)
        struct.pack_into("<d", raw, 136, a.shift)
        return bytes(raw)


class LasSource(DataSource):
    """Options of reading: recordsPerPartition, inside, listed, columns (a comma-separated list, as Spark doesn't tell a source which it needs), scaling."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def columns(self) -> list[str]:
        kinds = COLUMNS | SCALING
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or list(COLUMNS)
        if self.options.get("scaling", "false").lower() == "true":
            asked += [c for c in SCALING if c not in asked]
        if unknown := [c for c in asked if c not in kinds]:
            raise ValueError(f"no such columns: {unknown}")
        return asked

    def schema(self) -> str:
        return ", ".join(f"{c} {(COLUMNS | SCALING)[c]}" for c in self.columns())

    def reader(self, schema: object) -> LasReader:
        return LasReader(self.options, self.columns())

    def writer(self, schema: object, overwrite: bool) -> LasWriter:
        return LasWriter(self.options, overwrite)


class LasWaveforms(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_waveforms"

    def schema(self) -> str:
        return WAVEFORMS

    def reader(self, schema: object) -> WaveReader:
        return WaveReader(self.options)


class LasHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: object) -> HeaderReader:
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LasSource, LasHeaders, LasWaveforms):
        spark.dataSource.register(source)
