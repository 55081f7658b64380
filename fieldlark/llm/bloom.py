"""A bitmap of fixed size over the 64-bit ids of a table, for use before a join.

Its size is a constant, whatever the number of ids: with many ids it lets more
rows through, and the join that follows decides. It is a table of 32-bit words
that is broadcast, so marking rows is a lookup beside the scan, and no row moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlark.session import cut_lineage

BITS = 1 << 25  # at most 2**20 words


def bitmap(table: DataFrame, column: str) -> DataFrame:
    """(word, bits): the words of the bitmap that have a bit set, for the ids in *column*; null is no id."""
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))
    rows = table.where(F.col(column).isNotNull()).select(at.alias("at"))
    return cut_lineage(rows.groupBy(F.shiftright("at", 5).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("__bits")), "bitmap")


def marked(df: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """*df* with a column *flag* that is false only where the id in *column* is surely not among *ids* (a ``bitmap``)."""
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITS))
    hit = F.expr("(shiftright(__bits, cast(__at % 32 as int)) & 1) = 1")
    return (
        df.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 5))
        .join(F.broadcast(ids), "__word", "left")  # at most BITS / 32 rows
        .withColumn(flag, F.coalesce(hit & F.col(column).isNotNull(), F.lit(False)))
        .drop("__at", "__word", "__bits")
    )
