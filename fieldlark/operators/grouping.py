"""Choosing rows within a key without gathering the key in one task.

A key may hold a large share of all rows. ``pick_first`` is an aggregate, so all
but one row per key and map task disappear before the shuffle. ``top_per_key``
ranks once for a small n, of which every map task passes on n rows per key at most,
and in stages, each over a narrower spread of the key, for a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# a hot key is ranked in this many pieces first, then in fewer, then whole, if n is above this
SPREAD = (4096, 64)
SPREAD_FROM = 1000


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows of a table in which a task meets few copies.

    Rows are shuffled before copies are looked for, so no map task holds all its different rows, as it does for
    ``distinct``: what a task holds is its share of the shuffle.
    """
    return shuffled(df, *df.columns).distinct()


def shuffled(df: DataFrame, *columns: str) -> DataFrame:
    """The rows by these columns, always in the session's number of partitions: adaptive execution would put them
    together by their compressed bytes, of which rows of IRIs take thirty times the room."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is least in *order* (ascending, NULL first)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    chosen = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*")


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread_on: list[str],
    spread: tuple[int, ...] = SPREAD,
) -> DataFrame:
    """First *n* rows of each key in *order*, which must be a total order.

    The ranking drops rows beyond *n* in every map task, before the shuffle. For an *n*
    above ``SPREAD_FROM`` that is not enough: rows are spread by a hash of *spread_on*, and
    keeping the first *n* of every piece keeps the first *n* of the whole.
    """
    for pieces in (*(spread if n > SPREAD_FROM else ()), 1):
        piece = F.pmod(F.xxhash64(*spread_on), F.lit(pieces))
        by = keys if pieces == 1 else [*keys, piece]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        df = df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return df


def newest_key(date: Column) -> Column:
    """Sort key that puts the latest date first and a missing one last, for ``pick_first``."""
    return F.coalesce(-F.unix_date(date), F.lit(2**31 - 1))
