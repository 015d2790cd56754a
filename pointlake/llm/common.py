"""What the operators share: the shared folder, written tables, gapless ranks and text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_DIR: list[str] = []
_SCRATCH = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that is unset and all is one process (local tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set, and a cluster shares no other folder")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="pointlake-"))
    return f"file://{_OWN_DIR[0]}"


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if open_ := getattr(_SCRATCH, "open", None):
        open_[-1].append(path)
    return path


def catalogued(name: str) -> None:
    """Tell the open scratch of a table in the catalogue."""
    if open_ := getattr(_SCRATCH, "open", None):
        open_[-1].append(f"table {name}")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what the operators called inside wrote to the shared folder, and their tables' names.

    Results are lazy: write what is to stay before the end, to a path not made inside. It's deleted after an error, too.
    """
    _SCRATCH.open = [*getattr(_SCRATCH, "open", []), []]
    try:
        yield
    finally:
        *_SCRATCH.open, made = _SCRATCH.open
        for x in made:
            if x.startswith("table "):
                spark.sql(f"DROP TABLE IF EXISTS {x[6:]}")
            else:
                drop_path(spark, x)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; to `path`, if one was made before.

    This cuts the lineage, survives lost executors, and gives Catalyst the real
    size of the table, so that it broadcasts only what is small enough.
    """
    path = path or shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of jobs that are done: it learns of them from the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def fields(schema: StructType, more: str, *without: str) -> StructType:
    """The schema without some columns, and more fields as DDL."""
    return StructType([*(f for f in schema.fields if f.name not in without), *StructType.fromDDL(more).fields])


def pack_rest(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns and all others as one struct, so that no other column's name can clash."""
    others = [c for c in docs.columns if c not in own]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*own, rest.alias("__rest"))


def unpack_rest(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns again, in their order."""
    return df.select(*[F.col(c) if c in own else F.col("__rest")[c].alias(c) for c in columns])


def uniform(*cols: Column | str) -> Column:
    """A hash of cols as a double in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def running_rank(
    df: DataFrame, group: list[str], order: list[str], bucket: Column, weight: str | None = None, out: str = "offset"
) -> DataFrame:
    """Adds `out`: the number of rows (or sum of `weight`) of the same group before the row.

    The order is (bucket, *order). A group of any size is dealt over its buckets: first
    one small row per group and bucket is summed up, then each bucket counts on its own.
    Groups may be null. bucket must grow with the first column of `order`.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    df = df.withColumn("__b", bucket)
    sums = df.groupBy(*group, "__b").agg(F.sum(one).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__b").alias("__gb"),
        F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__before"),
    )
    sums = materialise(sums, "rank-sums")  # groups x buckets rows of known size, so that df isn't shuffled to meet them
    match = F.col("__b") == F.col("__gb")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("__in", F.coalesce(F.sum(one).over(inside), F.lit(0).cast("long")))
    return (
        ranked.join(sums, match, "left")
        .withColumn(out, F.col("__in") + F.col("__before"))
        .drop("__b", "__in", "__before", "__gb", *[f"__g{i}" for i in range(len(group))])
    )


# --- text buffers inside tasks -------------------------------------------------------

#: The six bytes that end a word.
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of the first word (n + 1 values)."""
    inside = ~IS_SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edges] = inside[edges]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = inside[lasts]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Hand freed memory back to the system: workers are used again, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        _POWERS["up"], _POWERS["down"] = _powers(_MULT, size), _powers(_MULT_INV, size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from the prefix sums."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
