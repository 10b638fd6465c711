"""Structured Streaming forms: incremental ingestion, windows, sessions.

Queries run with ``availableNow`` into Parquet with a checkpoint, both under the folder that
driver and executors share, and return the written table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema)
    if any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles()):
        # A stream's source is a folder; a table of one file is picked out by its name.
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream; event time needs a timestamp with a zone."""
    return read_table(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Count and mean value by window and type; events later than the watermark are dropped."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    counted = windows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """A user's events with no gap longer than ``gap``."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(rows: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def _first_of(ttl_ms: int):
    """Remembers the first document of a content, for a time."""

    def run(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        # Ids of one content in one micro-batch: the least is the first, where none was seen before.
        ids = np.concatenate([part["doc_id"].to_numpy() for part in parts])
        if not state.exists:
            state.update((int(ids.min()),))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"doc_id": ids, "content_hash": key[0], "first_id": state.get[0]})

    return run


def first_of_content(docs: DataFrame, ttl: str = "30 days") -> DataFrame:
    """doc_id, content_hash and duplicate_of (the first document of the same text, null for that itself) of a stream of documents.

    A content is remembered for ``ttl`` after it was first seen, from run to run. Null texts are the
    same as nothing. How many documents of one content come at once is bounded by the micro-batch.
    """
    amount, unit = ttl.split()
    ttl_ms = int(amount) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    keyed = docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.concat(F.lit("null:"), F.col("doc_id").cast("string"))).alias("content_hash")).where("doc_id IS NOT NULL")
    found = keyed.groupBy("content_hash").applyInPandasWithState(_first_of(ttl_ms), "doc_id long, content_hash string, first_id long", "first_id long", "append", "ProcessingTimeTimeout")
    return found.select("doc_id", "content_hash", F.when(F.col("first_id") != F.col("doc_id"), F.col("first_id")).alias("duplicate_of"))


def run_again(stream: DataFrame, base: str, timers: bool = False) -> None:
    """Runs a stream over what came since its last run at ``base``; adds to the table ``base``/out.

    A stream with processing-time ``timers`` always has another batch to run, so it is given one.
    """
    ends = {"once": True} if timers else {"availableNow": True}
    job = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(**ends).start()
    job.awaitTermination()


def run_to_end(stream: DataFrame, name: str, timers: bool = False) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run_again(stream, base, timers)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
