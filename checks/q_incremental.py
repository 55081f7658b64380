"""Reasoning over a change; a full run over the changed graph must give the same."""

from pyspark.sql import functions as F

from checks.q_reason import REASONED
from checks.registry import query
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators.joins import join_written
from fieldlark.operators.triples import has_type, link, to_triples
from fieldlark.plans.incremental import absent_from, update, without
from fieldlark.plans.reasoning import run_reasoner
from fieldlark.session import cut_lineage


def batch(t):
    """About a fiftieth of the species with their links and of the observations with their facts."""
    species, obs = F.concat(F.lit(V.taxon("species/c")), "n"), F.concat(F.lit(V.observation()), "n")
    nodes = t.given("customer").select(F.col("c_custkey").alias("n")).where("n % 50 = 7").select(species.alias("s")).unionByName(
        t.given("orders").select(F.col("o_orderkey").alias("n")).where("n % 50 = 7").select(obs.alias("s")))
    nodes = cut_lineage(nodes, "nodes")  # joined by its rows: the graph is cut down where it is read
    return join_written(t.graph, nodes, "s", "left_semi").unionByName(
        join_written(t.graph.where(F.col("p") == V.has_observation), nodes.withColumnRenamed("s", "o"), "o", "left_semi")).distinct()


@query("reasoned_after_adding", REASONED + " select s, p, o from r5")
def _(t):
    """A run without the batch, then the batch as a change."""
    part = cut_lineage(batch(t), "batch")
    before = run_reasoner(without(t.graph, part), V, is_distinct=True, is_by_predicate=True)
    return update(before.parts, added=part, vocab=V).triples.select("s", "p", "o")


@query("reasoned_after_removing", REASONED + " select s, p, o from r5")
def _(t):
    """A run with wrong links, sightings and equalities, which are then taken out."""
    node = F.concat(F.lit(V.taxon("species/c")), "c_custkey")
    wrong = to_triples(t.given("customer").where("c_custkey % 20 = 3"), [
        link(node, V.parent_taxon, F.concat(F.lit(V.taxon("family/")), (F.col("c_nationkey") + 1) % 25)),
        link(node, v.SAME_AS, F.concat(F.lit("http://wrong.example.org/"), F.col("c_custkey") % 4)),
        has_type(F.concat(F.lit("http://wrong.example.org/"), F.col("c_custkey") % 4), V.term("Genus")),
    ]).distinct()
    # none of them may be right by chance
    wrong = cut_lineage(absent_from(t.graph, cut_lineage(wrong, "wrong")), "wrong")
    before = run_reasoner(t.graph.unionByName(wrong), V, is_stored=True)
    return update(before.parts, removed=wrong, vocab=V).triples.select("s", "p", "o")
