"""The inference rules in sequence: every rule sees what the earlier ones added."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators import inference
from fieldlark.session import scratch_path
from fieldlark.sources.graph_files import read_graph, write_graph


class Reasoned(NamedTuple):
    triples: DataFrame
    added: DataFrame  # (step, rule, n) per rule
    parts: list[DataFrame]  # the asserted triples, then what each rule added


RULE_NAMES = ["transitive_parents", "subclass_types", "domain_types", "same_as", "migration"]


def rules(vocab: Vocab = DEFAULT):
    return list(zip(RULE_NAMES, [
        lambda g: inference.transitive_parents(g, vocab), inference.subclass_types, inference.domain_types,
        inference.same_as_one_hop, lambda g: inference.migration_rule(g, vocab)]))


def _store(triples: DataFrame, label: str, distinct: bool, by_predicate: bool = False) -> DataFrame:
    """Write to the shared checkpoint folder by predicate, so that a rule reads only what it matches."""
    spark = triples.sparkSession
    path = scratch_path(spark, label)
    write_graph(triples, path, distinct, by_predicate)
    return read_graph(spark, path)


def run_reasoner(
    triples: DataFrame, vocab: Vocab = DEFAULT, is_stored: bool = False, is_distinct: bool = False,
    is_by_predicate: bool = False) -> Reasoned:
    """The graph with all inferred triples, and how many each rule added.

    What a rule adds is written once to the shared checkpoint folder; the next
    rule and the counts read it from there. *is_stored* says that the input is
    read from distinct files by predicate already and need not be written first; *is_distinct*
    that no triple is there twice, so that it is written without looking for copies, and *is_by_predicate* that
    it comes from files by predicate, so that it is written as it is read.
    """
    graph = triples if is_stored else _store(triples, "asserted", is_distinct, is_by_predicate)
    counts, parts = [], [graph]
    for step, (name, rule) in enumerate(rules(vocab), start=1):
        new = _store(rule(graph), name, True)
        graph = graph.unionByName(new)
        parts.append(new)
        counts.append(new.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(step).alias("step"), F.lit(name).alias("rule"), "n"))
    added = counts[0]
    for more in counts[1:]:
        added = added.unionByName(more)
    return Reasoned(graph, added, parts)
