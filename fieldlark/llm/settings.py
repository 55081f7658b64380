"""Session settings that the work on long texts needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Hand rows to Python in batches of a bounded number of bytes; by default only the number of rows is bounded,
    and 10 000 long texts fill the memory of a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
