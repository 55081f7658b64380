"""Iterative graph operators: transitive pairs, reachable edges, components.

Every round is written to the shared checkpoint folder, so plans stay short and
a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlark.operators.joins import sized, spread_join
from fieldlark.session import cut_lineage


def transitive_pairs(edges: DataFrame) -> DataFrame:
    """All (node, ancestor) pairs of (child, parent) edges, direct ones included.

    Path lengths double each round: the pairs found last are extended by every
    pair known so far, so a chain of length n takes about log2(n) rounds. On a
    cycle a node is its own ancestor and the loop still ends.
    """
    known = cut_lineage(
        edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "pairs")
    frontier = known
    while True:
        sided = sized(known)
        longer = (
            spread_join(
                frontier.withColumnRenamed("ancestor", "via"), sided.withColumnRenamed("node", "via"), "via")
            .select("node", "ancestor")
            .distinct()
            .join(sided, ["node", "ancestor"], "left_anti")
        )
        frontier = cut_lineage(longer, "pairs")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def reachable_edges(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The distinct edges met when walking up from the nodes of *starts* (column ``node``).

    Works on distinct nodes, not on pairs: each node is visited once.
    """
    edges = cut_lineage(edges.select("child", "parent").distinct(), "edges")
    seen = cut_lineage(starts.select("node").distinct(), "seen")
    frontier = seen
    while True:
        parents = (
            edges.join(frontier.withColumnRenamed("node", "child"), "child", "left_semi")
            .select(F.col("parent").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
        )
        frontier = cut_lineage(parents, "seen")
        if frontier.isEmpty():
            return edges.join(seen.withColumnRenamed("node", "child"), "child", "left_semi")
        seen = seen.unionByName(frontier)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected (a, b) edges as (node, component).

    The component is named by its least node. Alternates the two star rewrites of
    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): the
    number of rounds is logarithmic, and a hub only ever contributes edges to its
    least neighbour, never pairs of its neighbours. The least neighbours are written
    before they are joined: both sides of the join are then plain reads, whose real
    size decides how they are joined, and a hub's rows can be split.
    """
    links = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    alone = links.where("u = v").select("u", "v")
    links = links.where("u <> v")
    while True:
        around = cut_lineage(_neighbourhoods(links), "around")
        # a forest of stars: every node has one link, and links lead to nodes without one
        if around.where("(n_less > 1) or (n_less > 0 and n_more > 0)").isEmpty():
            break
        large = cut_lineage(_large_star(links, around), "large")
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        links = cut_lineage(_small_star(large, least), "links")
    return (
        links.unionByName(links.select(F.col("v").alias("u"), "v")).unionByName(alone)
        .groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    )


def merge_components(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components after more (a, b) edges, and what changed, both as (node, component).

    *members* are those of ``components`` or of an earlier merge. The new edges are contracted to edges between the
    components they touch, and only those are joined, so the work follows the number of new edges; nodes of
    components that keep their name are passed through. The result equals ``components`` of all edges together.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b").distinct()
    ends = cut_lineage(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct(), "ends")
    # a node that is in no component yet is one of its own
    known = members.join(ends, "node", "left_semi")
    named = cut_lineage(ends.join(known, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("is_new")), "ends")
    name_of = named.select("node", "component")
    contracted = (
        edges.join(name_of.withColumnsRenamed({"node": "a", "component": "u"}), "a")
        .join(name_of.withColumnsRenamed({"node": "b", "component": "v"}), "b")
        .select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    )
    renamed = cut_lineage(
        components(contracted).where("node <> component").select(
            F.col("node").alias("component"), F.col("component").alias("_to")), "renamed")
    moved = spread_join(members, renamed, "component").select("node", F.col("_to").alias("component"))
    arrived = named.where("is_new").select("node", "component").join(renamed, "component", "left").select(
        "node", F.coalesce("_to", "component").alias("component"))
    changed = cut_lineage(moved.unionByName(arrived), "changed")
    kept = members.join(renamed.select("component"), "component", "left_anti").select("node", "component")
    return kept.unionByName(changed), changed


def _neighbourhoods(links: DataFrame) -> DataFrame:
    """Per node: the least of it and its neighbours, and how many neighbours are less and more than it."""
    one, none = F.lit(1).alias("less"), F.lit(0)
    both = links.select("u", "v", one, none.alias("more")).unionByName(
        links.select(F.col("v").alias("u"), F.col("u").alias("v"), none.alias("less"), F.lit(1).alias("more")))
    return both.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.sum("less").alias("n_less"), F.sum("more").alias("n_more"))


def _large_star(links: DataFrame, around: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of the node and its neighbours."""
    return links.select(F.col("v").alias("u"), F.col("u").alias("larger")).join(around.select("u", "m"), "u").select(
        F.col("larger").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node itself, to the least of them."""
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
