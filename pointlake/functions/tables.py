"""Written tables: they cut lineage, survive lost executors, and give Catalyst the real size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all is one process (local tests) a temporary folder."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set, and a cluster shares no other folder")
    if not _OWN_DIR:
        _OWN_DIR.append(f"file://{tempfile.mkdtemp(prefix='pointlake-')}")
    return _OWN_DIR[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
