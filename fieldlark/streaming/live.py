"""Streaming forms of the live-sighting and session operators.

Inputs are streaming DataFrames with an event-time column of type TIMESTAMP;
rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldlark.operators.extracts import IDLE_SECONDS
from fieldlark.session import scratch_path


def sightings_per_window(
    stream: DataFrame, key: str, ts: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sightings per key and time window."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, width), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")
    )


def session_stream(
    stream: DataFrame, key: str, ts: str, idle_seconds: int = IDLE_SECONDS, late: str = "2 hours") -> DataFrame:
    """Sessions that a pause of *idle_seconds* closes, emitted once the watermark has passed them.

    A key's rows meet in one task; ``batches.run_sessions`` is for keys that hold a large share of them.
    """
    gap = f"{idle_seconds * 1_000_000 - 1} microseconds"  # windows that touch are one session, and a whole pause parts two
    return (
        stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ended"))
        .select(key, F.col("session_window.start").alias("started"), "ended", "n")
    )


def flag_stream(stream: DataFrame, expected: DataFrame, code: str, expected_code: str) -> DataFrame:
    """Arriving sightings, each marked when its species is among the expected ones."""
    codes = expected.select(F.col(expected_code).alias("_code")).distinct().withColumn("_known", F.lit(True))
    return (
        stream.join(codes, F.col(code) == F.col("_code"), "left")
        .withColumn("is_expected", F.col("_known").isNotNull()).drop("_code", "_known")
    )


def first_arrivals(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to parquet; by default everything available is processed and the query stops."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, wait, and return what was written to the shared folder."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    query = start_to_parquet(stream, f"{root}/out", f"{root}/state")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
