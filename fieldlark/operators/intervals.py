"""Nested intervals of a taxonomy: drill-down and ancestors by comparisons of numbers.

``interval_labels`` numbers the taxa in the order of a walk through the forest and gives
every taxon the interval [lo, hi] of the numbers at or below it. "All below X" is then
``lo`` between X's bounds, "ancestors of X" those whose bounds enclose X's number: plain
range filters that reach a file scan, without a loop. The walk is an Euler tour as a
linked list of entries and exits, ranked in parallel, so a chain takes logarithmic rounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from fieldlark.operators.joins import spread_join
from fieldlark.operators.ordering import POS, SIZE, list_ranks, ranked, running_totals
from fieldlark.session import cut_lineage

LABELS = ["node", "parent", "root", "depth", "lo", "hi"]
NO_PARENT = -1


class Interval(NamedTuple):
    lo: int
    hi: int


class Forest(NamedTuple):
    labels: DataFrame  # (node, parent, root, depth, lo, hi)
    in_cycles: DataFrame  # (node, parent, on_cycle): taxa on or below a cycle, which have no label


def direct_edges(edges: DataFrame) -> DataFrame:
    """The (child, parent) edges that no chain of two others spans.

    A graph whose links were closed gives its direct links back; a forest stays as it is.
    """
    edges = edges.select("child", "parent").distinct()
    steps = edges.where("child <> parent")
    spanned = spread_join(
        steps.withColumnRenamed("parent", "via"), steps.select(F.col("child").alias("via"), F.col("parent")), "via"
    ).where("child <> parent").select("child", "parent").distinct()
    return edges.join(spanned, ["child", "parent"], "left_anti")


def parent_table(edges: DataFrame) -> DataFrame:
    """(node, parent): every node of the edges once. Of several parents the least counts, itself only if there is no other."""
    child, parent = F.col("child"), F.col("parent")
    edges = edges.where(child.isNotNull() & parent.isNotNull())
    sides = edges.select(child.alias("node"), parent).unionByName(
        edges.select(parent.alias("node"), F.lit(None).cast("string").alias("parent")))
    other = F.min(F.when(F.col("parent") != F.col("node"), F.col("parent")))
    return sides.groupBy("node").agg(F.coalesce(other, F.max("parent")).alias("parent"))


def other_parents(edges: DataFrame) -> DataFrame:
    """The distinct edges that the forest leaves out, because their child has a lesser parent."""
    return edges.where("child is not null and parent is not null").select("child", "parent").distinct().join(
        parent_table(edges).where("parent is not null").withColumnRenamed("node", "child"), ["child", "parent"], "left_anti")


def _climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root, depth) of the nodes under a root, and (id, at) of the others, where *at* is on a cycle.

    Pointers double. A round in which no node arrives is the last: below a root there are nodes of every depth.
    """
    start = F.col("up") == NO_PARENT
    done = cut_lineage(nodes.where(start).select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth")), "roots")
    open_ = cut_lineage(nodes.where(~start).select("id", F.col("up").alias("at"), F.lit(1).cast("long").alias("dist")), "climbing")
    steps = 0
    while not open_.isEmpty():
        here = done.select(F.col("id").alias("at"), F.lit(None).cast("long").alias("then"), "depth", "root").unionByName(
            open_.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("dist").alias("depth"), F.lit(None).cast("long").alias("root")))
        moved = cut_lineage(spread_join(open_, here, "at").select(
            "id", "root", F.col("then").alias("at"), (F.col("dist") + F.col("depth")).alias("dist")), "climbing")
        arrived = moved.where("root is not null").select("id", "root", F.col("dist").alias("depth"))
        if arrived.isEmpty():
            left, steps = moved.count(), steps + 1
            while 2 ** steps < left:  # until every pointer has gone round
                moved = cut_lineage(spread_join(moved, moved.select(F.col("id").alias("at"), F.col("at").alias("then")), "at").select(
                    "id", F.col("then").alias("at")), "climbing")
                steps += 1
            return done, moved.select("id", "at")
        done, open_, steps = done.unionByName(arrived), moved.where("root is null").select("id", "at", "dist"), steps + 1
    return done, open_.select("id", "at")


def interval_labels(edges: DataFrame) -> Forest:
    """Intervals of the forest of (child, parent) edges.

    Siblings and roots are walked in the order of their names. Of several parents the least counts, ``other_parents``
    lists the rest; give ``direct_edges`` of links that were closed. A null on either side is no edge. Taxa on a cycle,
    and what hangs below one, get no interval and are listed in ``in_cycles``. No edges give no rows.
    """
    placed = ranked(
        parent_table(edges), F.coalesce(F.concat(F.lit("="), "parent"), F.lit("")), [F.col("node")], "siblings")
    nodes = cut_lineage(placed.select("node", "parent", F.col(POS).alias("pos"), F.col(SIZE).alias("size")).withColumn(
        "id", F.monotonically_increasing_id()), "taxa")
    up = nodes.select(F.col("node").alias("parent"), F.col("id").alias("up"))
    nodes = cut_lineage(spread_join(nodes, up, "parent", "left").withColumn("up", F.coalesce("up", F.lit(NO_PARENT))), "taxa")
    done, circling = _climbed(nodes)
    done = cut_lineage(done, "climbed")
    walked = cut_lineage(spread_join(nodes, done, "id"), "taxa")

    # an element of the walk is 2 * id for the entry and 2 * id + 1 for the exit
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    first = walked.where((F.col("pos") == 0) & (F.col("up") != NO_PARENT)).select(
        F.col("up").alias("id"), (F.col("id") * 2).alias("into"))
    entries = walked.join(first, "id", "left").select(
        enter.alias("id"), F.coalesce("into", leave).alias("next"), F.lit(1).cast("long").alias("weight"))
    beside = walked.select("up", (F.col("pos") - 1).alias("pos"), (F.col("id") * 2).alias("beside"))
    exits = walked.join(beside, ["up", "pos"], "left").select(
        leave.alias("id"),
        F.coalesce("beside", F.when(F.col("up") != NO_PARENT, F.col("up") * 2 + 1)).alias("next"),
        F.lit(0).cast("long").alias("weight"))
    ranks = cut_lineage(list_ranks(entries.unionByName(exits), "tour"), "tour")
    n = done.count()
    bounds = ranks.groupBy(F.shiftright("id", 1).alias("id")).agg(
        (F.lit(n) - F.max(F.when(F.col("id") % 2 == 0, F.col("rank")))).alias("lo"),
        (F.lit(n) - 1 - F.max(F.when(F.col("id") % 2 == 1, F.col("rank")))).alias("hi"))
    names = nodes.select(F.col("id").alias("root"), F.col("node").alias("root_name"))
    labels = spread_join(walked.join(bounds, "id"), names, "root").select(
        "node", "parent", F.col("root_name").alias("root"), "depth", "lo", "hi")

    on_cycle = circling.select(F.col("at").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    in_cycles = nodes.join(circling.select("id"), "id").join(on_cycle, "id", "left").select(
        "node", "parent", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    return Forest(labels, in_cycles)


def interval_of(labels: DataFrame, node: str) -> Interval | None:
    """Bounds of one taxon: a look-up of one row, whose numbers then go into the filters."""
    row = labels.where(F.col("node") == node).select("lo", "hi").first()
    return Interval(*row) if row else None


def below(labels: DataFrame, bounds: Interval | None) -> DataFrame:
    """The taxa below a taxon, itself left out; none for an unknown one."""
    if bounds is None:
        return labels.limit(0)
    return labels.where((F.col("lo") > bounds.lo) & (F.col("lo") <= bounds.hi))


def above(labels: DataFrame, bounds: Interval | None) -> DataFrame:
    """The ancestors of a taxon, itself left out."""
    if bounds is None:
        return labels.limit(0)
    return labels.where((F.col("lo") < bounds.lo) & (F.col("hi") >= bounds.hi))


def counts_below(labels: DataFrame, marked: DataFrame) -> DataFrame:
    """*labels* with ``n_below``: the different nodes of *marked* (column ``node``) at or below each taxon.

    Two look-ups in running totals over the numbers of the walk, whatever the depth.
    """
    marks = spread_join(labels.select("node", "lo"), marked.select("node").distinct().withColumn("value", F.lit(1)), "node", "left")
    totals = cut_lineage(running_totals(
        marks.select(F.col("lo").alias("at"), F.coalesce("value", F.lit(0)).cast("long").alias("value")), "totals"), "totals")
    upto = totals.select(F.col("at").alias("hi"), F.col("total").alias("upto"))
    before = totals.select((F.col("at") + 1).alias("lo"), F.col("total").alias("before"))
    return labels.join(before, "lo", "left").join(upto, "hi").select(
        *labels.columns, (F.col("upto") - F.coalesce("before", F.lit(0))).alias("n_below"))
