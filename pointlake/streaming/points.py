"""Streams of points or events: thinning by time, duplicates, and sessions, with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; its times become timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def thin_by_time(stream: DataFrame, key: str, every: str, late: str = "1 hour") -> DataFrame:
    """One event for each key and span of time: the earliest (of equal times the smallest id)."""
    first = F.min(F.struct("ts", "event_id"))
    made = stream.withWatermark("ts", late).groupBy(F.window("ts", every), key).agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    return made.select(key, F.col("window.start").alias("start"), F.col("f.event_id").alias("event_id"), "n")


def drop_repeats(stream: DataFrame, columns: list[str], late: str = "1 hour") -> DataFrame:
    """The first of equal events within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(columns)


def sessions(stream: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Flight lines of a stream: runs of a key's events without a gap."""
    made = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(key, F.col("session_window.start").alias("start"), "n", F.round("total", 4).alias("total"))


def counts_by_window(stream: DataFrame, every: str, by: Column | str, late: str = "1 hour") -> DataFrame:
    made = stream.withWatermark("ts", late).groupBy(F.window("ts", every), by).agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.col("window.start").alias("start"), by, "n")


def run_to_end(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Writes the rows of what the stream holds now to `out` as Parquet and reads them: for streams whose rows leave at once."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_whole(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Aggregates of everything that the stream holds now, those of windows still open included.

    Complete mode hands on all windows after each batch; every batch writes a table of its own
    below `out`, and the last one is read. A batch that is run again replaces its own table.
    """
    last: list[int] = []

    def keep(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/{batch}")
        last[:] = [batch]

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[0]}") if last else spark.createDataFrame([], stream.schema)
