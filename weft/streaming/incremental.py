"""Streams: files ingested as they arrive, and event-time aggregates of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import mime_of, modality_of
from weft.model import Options
from weft.plans.ingest import Providers, ingest

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_arrivals(spark: SparkSession, folder: str, options: Options, checkpoint: str, providers: Providers | None = None) -> list[dict]:
    """Ingest the files that arrived since the last call, through the same batch plan as a full run.

    The stream only says which files are new; content identity makes a batch that
    is run twice harmless. Empty files and names that begin with _ or . are not
    seen by the stream and are left to a full run. Returns a report per batch.
    """
    arrived = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(folder)
    root = options.root.rstrip("/")
    files = arrived.select(
        F.regexp_replace("path", "^file:/+", "/").alias("abspath"), F.col("modificationTime").cast("long").alias("mtime"), F.col("length").alias("size")
    ).withColumn("relpath", F.expr(f"substring(abspath, {len(root) + 2})"))
    files = files.select("relpath", "abspath", "mtime", "size", mime_of(F.col("relpath")).alias("mime"), modality_of(F.col("relpath")).alias("modality"))
    reports: list[dict] = []

    def batch(df: DataFrame, _: int) -> None:
        reports.append(ingest(spark, options, providers, files=df))

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return reports


def windowed(events: DataFrame, time: str, length: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum per event-time window and keys; works on a stream (with the watermark) and on a table alike."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), *keys, "n", "total"
    )


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a stream's present input into Parquet files."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
