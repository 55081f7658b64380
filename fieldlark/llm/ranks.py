"""Places of rows within groups of any size.

A window over a whole group would bring a hot group into one task. Here rows are
dealt out by ranges of (group, order), so a group lies in as many ranges as it
needs; each range numbers its own rows, and the sizes of the ranges before give
the offset. Only the small table of (range, group) sizes meets by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.session import cut_lineage

RANGE, GROUP, POS, SIZE = "__range", "__group", "__pos", "__size"


def ranked(df: DataFrame, group: Column, order: list[Column], label: str) -> DataFrame:
    """*df* with __group, __pos (from 0) and __size (rows of the group). *group* must not be null.

    *order* is ascending with nulls first. Rows equal in *order* get different places, in no stated order among
    them; so many of them that they fill more than a range are still spread.
    """
    rows = cut_lineage(df.withColumns({GROUP: group, "__tie": F.monotonically_increasing_id()}), label)
    keys = [f"__o{i}" for i in range(len(order))]
    rows = rows.withColumns(dict(zip(keys, order)))
    dealt = cut_lineage(
        rows.repartitionByRange(GROUP, *keys, "__tie").withColumn(RANGE, F.spark_partition_id()), label)
    before = Window.partitionBy(GROUP).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(RANGE, GROUP).agg(F.count("*").alias("__rows")).select(
        RANGE, GROUP, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(GROUP)).alias(SIZE))
    inside = Window.partitionBy(RANGE, GROUP).orderBy(*keys, "__tie")
    return (
        dealt.withColumn("__in", F.row_number().over(inside))
        .join(sizes, [RANGE, GROUP])
        .withColumn(POS, F.col("__before") + F.col("__in") - 1)
        .drop(RANGE, "__in", "__before", "__tie", *keys)
    )
