"""Places in an order, for rows and lists of any size.

``ranked`` numbers the rows of groups without bringing a group into one task,
``running_totals`` adds up over dense numbers, and ``list_ranks`` over linked lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.operators.joins import spread_join
from fieldlark.session import cut_lineage

RANGE, GROUP, POS, SIZE = "__range", "__group", "__pos", "__size"

# one element in so many is a stop of the first phase of ``list_ranks``
STOPS = 32
# so many numbers are added up in one window of ``running_totals``
BUCKET_BITS = 12


def ranked(df: DataFrame, group: Column, order: list[Column], label: str) -> DataFrame:
    """*df* with __group, __pos (from 0) and __size (rows of the group). *group* must not be null.

    Rows are dealt out by ranges of (group, order), so a group lies in as many ranges as it needs; each range numbers
    its own rows and the sizes of the ranges before give the offset. Only the small table of (range, group) sizes
    meets by group. *order* is ascending with nulls first. Rows equal in *order* get different places, in no stated
    order among them; so many of them that they fill more than a range are still spread.
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


def running_totals(values: DataFrame, label: str) -> DataFrame:
    """(at, total) of (at, value) rows with different numbers *at* from 0 on: the sum of all values up to *at*.

    Numbers are added up in buckets, the sums of the buckets the same way, so a window holds one bucket.
    """
    values = cut_lineage(values.select("at", "value"), label)
    most = values.agg(F.max("at")).first()[0]  # one number
    inside = F.sum("value").over(Window.partitionBy("bucket").orderBy("at"))
    bucketed = values.withColumn("bucket", F.shiftright("at", BUCKET_BITS))
    if most is None or most < 1 << BUCKET_BITS:
        return bucketed.select("at", inside.alias("total"))
    sums = bucketed.groupBy("bucket").agg(F.sum("value").alias("value"))
    ends = running_totals(sums.select(F.col("bucket").alias("at"), "value"), label)
    before = ends.join(sums, ends["at"] == sums["bucket"]).select("bucket", (F.col("total") - F.col("value")).alias("before"))
    return bucketed.withColumn("inside", inside).join(before, "bucket").select(
        "at", (F.col("inside") + F.col("before")).alias("total"))


def _jump(links: DataFrame, rests: Column, label: str) -> DataFrame:
    """(id, next, weight) where every link has been followed until it rests, with the weights on the way added.

    A link is joined with the state of what it leads to, so the length it spans doubles each round. Links that rest
    are only looked up.
    """
    state = cut_lineage(links.withColumn("rests", rests), label)
    while not state.where("not rests").isEmpty():
        target = state.select(
            F.col("id").alias("next"), F.col("next").alias("then"), F.col("weight").alias("more"), F.col("rests").alias("last"))
        moved = spread_join(state.where("not rests"), target, "next").select(
            "id", F.col("then").alias("next"), (F.col("weight") + F.col("more")).alias("weight"), F.col("last").alias("rests"))
        state = cut_lineage(state.where("rests").unionByName(moved), label)
    return state.drop("rests")


def list_ranks(links: DataFrame, label: str) -> DataFrame:
    """(id, rank) of linked lists (id, next, weight): the weights from an element to the end of its list, itself included.

    *next* is null at an end; ids are long numbers, and no list may be a circle. Every element first jumps to the next
    of a few stops drawn by a hash, then the stops rank each other, so the rounds over all elements number about the
    logarithm of the distance between stops, and only one element in STOPS takes part in the others.
    """
    def is_stop(element: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(label), F.col(element)), F.lit(STOPS)) == 0

    end = F.col("next").isNull()
    near = _jump(links.select("id", "next", "weight"), end | is_stop("next"), label)
    stops = _jump(near.where(is_stop("id")), end, label)
    rest = stops.select(F.col("id").alias("next"), F.col("weight").alias("rest"))
    return spread_join(near, rest, "next", "left").select(
        "id", (F.col("weight") + F.coalesce("rest", F.lit(0))).alias("rank"))
