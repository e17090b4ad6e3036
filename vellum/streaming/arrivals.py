"""Streams: files as they arrive, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import packages
from vellum.sources import readers

#: Schema of Spark's binary file source.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of files as they come into a folder."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("path", "content")


def parsed(spark: SparkSession, path: str, table: str, pattern: str = "*", mode: str = "PERMISSIVE", **options) -> DataFrame:
    """A table of the files as they come; parsing is by file, so it needs no
    state."""
    return readers.parse(arriving(spark, path, pattern), table, mode, **options)


def convert(spark: SparkSession, path: str, conversion: Callable[[DataFrame], DataFrame], directory: str, suffix: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Start a query that writes a package for each arriving file and the
    files that gave none to ``directory``/_errors. A batch that runs again
    writes the same files and the same rows of errors."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        out = conversion(batch).persist()
        packages.save(out.where(F.col("content").isNotNull()).select("path", "content"), directory, suffix).count()
        out.where(F.col("content").isNull()).select("path", "_error").write.mode("overwrite").parquet(f"{directory}/_errors/batch={number}")
        out.unpersist()
        batch.unpersist()

    return arriving(spark, path, pattern).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events counted and summed by window and type; a window closes once the
    watermark, ``late`` behind the newest event, is past its end."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "event_type")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: events with no greater gap between them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    out = rows.agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
