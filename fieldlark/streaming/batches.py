"""Streams that keep what they know in files: first arrivals, flags from a changing table, sessions of busy keys.

Each micro-batch is an ordinary job over the batch and the files of earlier ones, so
adaptive execution can split a hot key, and nothing is kept in the memory of one task.
A batch writes to a folder named by its number and replaces it, so a batch that is run
again after a failure leaves no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldlark.operators.extracts import IDLE_SECONDS
from fieldlark.operators.joins import spread_join
from fieldlark.session import scratch_path
from fieldlark.streaming.live import run_available


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Give every micro-batch to *step* with its number; by default what is available, then the query stops."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _replace_batch(rows: DataFrame, path: str, number: int, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={number}")


def _written_batches(spark: SparkSession, schema: T.StructType, path: str, *by: tuple[str, T.DataType]) -> DataFrame:
    """Rows of all batches in *path*, which may hold none yet."""
    fields = [T.StructField(name, kind) for name, kind in (*by, ("batch", T.LongType()))]
    nowhere = "".join(f"/{name}=-1" for name, _ in by)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1{nowhere}")  # so that there is a folder
    return spark.read.schema(T.StructType([*schema.fields, *fields])).parquet(path).where("batch >= 0")


# -- first arrivals -----------------------------------------------------------

def period_of(ts: Column, seconds: int) -> Column:
    """Number of the period that a time is in, periods counted from 1970."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds)).cast("long")


def keep_first_arrivals(batch: DataFrame, number: int, path: str, keys: list[str], ts: str, seconds: int) -> None:
    """Write the rows of a batch whose keys no earlier batch has in the same period, the earliest of each.

    A hot key is one row per map task before the shuffle. Of the earlier batches only the periods of this one are read.
    """
    timed = batch.where(F.col(ts).isNotNull()).withColumn("period", period_of(F.col(ts), seconds))
    rest = [c for c in batch.columns if c not in keys]
    first = timed.groupBy(*keys, "period").agg(F.min_by(F.struct(*rest), F.struct(ts, F.xxhash64(*rest))).alias("_row"))
    first = first.select(*keys, "_row.*", "period").select(*batch.columns, "period")
    periods = [r.period for r in first.select("period").distinct().collect()]  # those of one batch
    seen = _written_batches(batch.sparkSession, batch.schema, path, ("period", T.LongType())).where(
        (F.col("batch") < number) & F.col("period").isin(periods))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "period")]
    fresh = first.alias("f").join(seen.alias("s"), same, "left_anti")
    _replace_batch(fresh, path, number, "period")


def first_arrivals_to(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], ts: str, seconds: int, **trigger) -> StreamingQuery:
    """Append to *path* one row per key and period of so many seconds; rows without a time are left out."""
    return run_batches(
        stream, lambda batch, number: keep_first_arrivals(batch, number, path, keys, ts, seconds), checkpoint, **trigger)


def read_arrivals(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return _written_batches(spark, schema, path, ("period", T.LongType())).drop("batch")


# -- flags from a changing table ------------------------------------------------

def publish_expected(expected: DataFrame, path: str, version: int) -> None:
    """Store a version of the expected codes (column ``code``); streams use it from their next batch on."""
    expected.select("code").where("code is not null").distinct().write.parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int:
    """The highest version that is there; found from the folder names alone."""
    return spark.read.schema("code string, version long").parquet(path).agg(F.max("version")).first()[0]


def flag_batch(batch: DataFrame, number: int, path: str, code: str, expected: str) -> None:
    """Write a batch with ``is_expected`` and the ``version`` of the table that said so.

    The codes of the batch, once each, select what is read of the table; only those known are joined with the rows.
    """
    spark = batch.sparkSession
    version = newest_version(spark, expected)
    table = spark.read.schema("code string, version long").parquet(expected).where(F.col("version") == version)
    asked = batch.select(F.col(code).alias("code")).distinct()
    known = table.join(asked, "code", "left_semi").select(F.col("code").alias(code), F.lit(True).alias("_known"))
    flagged = spread_join(batch, known, code, "left").withColumns({
        "is_expected": F.col("_known").isNotNull(), "version": F.lit(version).cast("long")}).drop("_known")
    flagged.write.mode("overwrite").parquet(f"{path}/batch={number}")


def flags_to(stream: DataFrame, path: str, checkpoint: str, code: str, expected: str, **trigger) -> StreamingQuery:
    """Append arriving rows to *path*, flagged by the newest version of the table in the folder *expected*."""
    return run_batches(stream, lambda batch, number: flag_batch(batch, number, path, code, expected), checkpoint, **trigger)


def read_flags(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return _written_batches(spark, T.StructType([
        *schema.fields, T.StructField("is_expected", T.BooleanType()), T.StructField("version", T.LongType())]), path).drop("batch")


# -- sessions of busy keys --------------------------------------------------------

def slot_stream(stream: DataFrame, key: str, ts: str, idle_seconds: int = IDLE_SECONDS, late: str = "2 hours") -> DataFrame:
    """(key, first_ts, last_ts, n) per slot one pause long, once the watermark has passed the slot.

    Rows of a slot are always in one session. They are combined in every map task, so a hot key moves one row per
    task and slot.
    """
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, f"{idle_seconds} seconds"), key)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
        .select(key, "first_ts", "last_ts", "n")
    )


def sessions_of_slots(slots: DataFrame, key: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions (key, started, ended, n) of a stream of slots: a slot holds its session open until a pause after its
    last row. A slot arrives at most one pause behind a later one, which is the delay the watermark allows."""
    # windows that touch are one session, and a whole pause parts two
    gap = F.unix_micros("last_ts") - F.unix_micros("first_ts") + F.lit(idle_seconds * 1_000_000 - 1)
    held = F.concat(gap.cast("string"), F.lit(" microseconds"))
    return (
        slots.withWatermark("first_ts", f"{idle_seconds} seconds").groupBy(F.session_window("first_ts", held), key)
        .agg(F.max("last_ts").alias("ended"), F.sum("n").alias("n"))
        .select(key, F.col("session_window.start").alias("started"), "ended", "n")
    )


def run_sessions(stream: DataFrame, key: str, ts: str, idle_seconds: int = IDLE_SECONDS, late: str = "2 hours") -> DataFrame:
    """Process what is there as slots, and the slots as sessions; the closed sessions."""
    spark = stream.sparkSession
    slots = run_available(slot_stream(stream, key, ts, idle_seconds, late), "slots")
    folder = scratch_path(spark, "slots")
    slots.write.parquet(folder)
    return run_available(sessions_of_slots(spark.readStream.schema(slots.schema).parquet(folder), key, idle_seconds), "sessions")
