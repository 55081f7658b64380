"""Observations stored by month, read from the newest month on until there are enough.

How many observations a month has is stored beside them: one row a month, which the
driver reads. A search for the newest takes the newest months that may suffice, counts
what its filters leave of them, and goes further back only if that is too little.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def write_by_month(observations: DataFrame, order: list[str], path: str) -> None:
    """Store observations in a folder per month, each sorted by *order*, and the number of them in each, in new folders
    ``observations`` and ``month_counts``. Those without a date have a folder of their own."""
    month = F.year("observed_on") * 100 + F.month("observed_on")
    observations.withColumn("month", month).hint("rebalance", "month").sortWithinPartitions("month", *order).write.partitionBy(
        "month").parquet(f"{path}/observations")
    schema = T.StructType([*observations.schema.fields, T.StructField("month", T.IntegerType())])
    stored = observations.sparkSession.read.schema(schema).parquet(f"{path}/observations")
    stored.where("month is not null").groupBy("month").agg(F.count("*").alias("n")).write.parquet(f"{path}/month_counts")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/month_counts")


def of_months(observations: DataFrame, months: list[int]) -> DataFrame:
    """Observations of these months; no other folder is opened."""
    return observations.where(F.col("month").isin(months))


def months_needed(counts: dict[int, int], limit: int, found_in: Callable[[list[int]], int]) -> list[int]:
    """The newest months that hold *limit* observations that count, or all.

    *found_in* counts them in some months, up to the limit. A month is newer than another whatever its filters leave,
    so enough in the newest ones is enough. If filters leave too few, twice as many observations are tried.
    """
    newest, wanted = sorted(counts, reverse=True), limit
    while True:
        chosen, held = [], 0
        for month in newest:
            if held >= wanted:
                break
            chosen.append(month)
            held += counts[month]
        if len(chosen) == len(newest) or found_in(chosen) >= limit:
            return chosen
        wanted = 2 * held
