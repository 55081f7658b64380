"""Reasoning over a change: the inferred triples after a batch of triples came or went, without a full run.

A reasoned graph is kept in parts: what was asserted, and what each rule added to the
parts before it. For every rule in turn, ``update`` finds the conclusions that used a
triple that went (over-deletion), keeps those of them that other triples still yield
(re-derivation), and finds those that use a triple that came (delta evaluation). What
changed in a part is the change that the next rule sees.

Whatever is as large as the graph is only read through a join with a small written
table of changed keys, so it is filtered where it is scanned: by the keys themselves,
where they are few, else by a bitmap of bounded size, behind which the rows that are
left are shuffled (``join_written``).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlark.model import vocab as v
from fieldlark.model.types import TRIPLE, TRIPLE_COLUMNS
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators import closure, inference
from fieldlark.operators.inference import iri_rows
from fieldlark.operators.joins import has_few_rows, join_written, may_match
from fieldlark.operators.triples import pattern, scan
from fieldlark.plans.reasoning import RULE_NAMES
from fieldlark.session import cut_lineage
from fieldlark.sources.graph_files import read_graph, write_graph


class Change(NamedTuple):
    """Triples of a graph that went and that came; they share none."""

    gone: DataFrame
    new: DataFrame


class Revision(NamedTuple):
    """Conclusions of a rule that used what went, and those that hold now and used what went or came."""

    doubtful: DataFrame
    holding: DataFrame


class Updated(NamedTuple):
    parts: list[DataFrame]  # asserted, then one part per rule
    changes: DataFrame  # (step, rule, n_gone, n_new) of the parts, step 0 being the asserted one

    @property
    def triples(self) -> DataFrame:
        return union(self.parts)


def union(graphs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), graphs)


def within(large: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows of *large* whose key is in *small*."""
    return join_written(large, small, on, "left_semi")


def minus(rows: DataFrame, other: DataFrame) -> DataFrame:
    return join_written(rows, other, TRIPLE_COLUMNS, "left_anti")


def named_in(rows: DataFrame) -> Column:
    """Whether the predicate is one of *rows*, which are written; files of other predicates are not read."""
    return F.col("p").isin([r.p for r in rows.select("p").distinct().collect()])


def held(large: DataFrame, rows: DataFrame) -> DataFrame:
    """The triples of *large* that are among the *rows*; only their predicates are read."""
    return within(large.where(named_in(rows)), rows, TRIPLE_COLUMNS)


def without(large: DataFrame, rows: DataFrame) -> DataFrame:
    """*large* less the *rows*; triples of other predicates are passed on as they are read."""
    named = named_in(rows)
    return minus(large.where(named), rows).unionByName(large.where(~named))


def absent_from(large: DataFrame, rows: DataFrame) -> DataFrame:
    """The different *rows* that *large* does not hold; *large* is cut down to them and their predicates where it is read."""
    rows = rows.select(*TRIPLE_COLUMNS)
    there = may_match(large.where(named_in(rows)).select(*TRIPLE_COLUMNS), rows, TRIPLE_COLUMNS)
    return inference.not_there(rows, there, has_few_rows(rows))


def _known(written: DataFrame) -> DataFrame:
    """The written rows; if there are none, the optimizer is told, and what is joined with them is not read."""
    return written.limit(0) if written.isEmpty() else written


def _written(rows: DataFrame, label: str) -> DataFrame:
    return _known(cut_lineage(rows.select(*TRIPLE_COLUMNS).distinct(), label))


# -- the rules ----------------------------------------------------------------

def _through(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, ancestor) pairs of which some path uses one of the *edges* (node, ancestor), with *pairs* closed."""
    up = join_written(pairs.withColumnRenamed("ancestor", "via"), edges.withColumnRenamed("node", "via"), "via").select("node", "ancestor")
    upto = cut_lineage(edges.unionByName(up).distinct(), "through")
    on = join_written(pairs.withColumnRenamed("node", "via"), upto.withColumnRenamed("ancestor", "via"), "via").select("node", "ancestor")
    return cut_lineage(upto.unionByName(on).distinct(), "through")


def _closed_over(found: DataFrame) -> DataFrame:
    """*found* with all chains of its pairs."""
    while True:
        chains = join_written(found.withColumnRenamed("ancestor", "via"), found.withColumnRenamed("node", "via"), "via")
        more = cut_lineage(
            join_written(chains.select("node", "ancestor").distinct(), found, ["node", "ancestor"], "left_anti"), "through")
        if more.isEmpty():
            return found
        found = found.unionByName(more)


def revise_parents(old: DataFrame, fresh: DataFrame, known: DataFrame, change: Change, vocab: Vocab) -> Revision:
    """Transitive parents. The old closure is the old links and what the rule added to them."""
    def pairs(triples):
        return pattern(triples, "node", vocab.parent_taxon, "ancestor")

    def rows(found):
        return iri_rows(found, "node", vocab.parent_taxon, "ancestor")

    gone, new = cut_lineage(pairs(change.gone).distinct(), "edges"), cut_lineage(pairs(change.new).distinct(), "edges")
    closed = pairs(old.unionByName(known))
    if gone.isEmpty():
        doubtful = kept = gone
        intact = closed
    else:
        doubtful = _through(gone, closed)
        # what is above the nodes in doubt, and the links that are left there
        nodes = doubtful.select("node").distinct()
        region = cut_lineage(within(closed, nodes, ["node"]).select(F.col("ancestor").alias("node")).unionByName(nodes).distinct(), "region")
        left = join_written(within(pairs(old), region, ["node"]), gone, ["node", "ancestor"], "left_anti")
        around = closure.transitive_pairs(left.withColumnsRenamed({"node": "child", "ancestor": "parent"}))
        kept = cut_lineage(within(around, doubtful, ["node", "ancestor"]), "kept")
        intact = join_written(closed, doubtful, ["node", "ancestor"], "left_anti").unionByName(kept)
    found = new if new.isEmpty() else _closed_over(_through(new, intact))
    return Revision(rows(doubtful), rows(kept.unionByName(found)))


def _changed(old: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a small table that went, and that came."""
    return cut_lineage(old.join(fresh, old.columns, "left_anti"), "went"), cut_lineage(fresh.join(old, old.columns, "left_anti"), "came")


def terms(table: DataFrame, term: str, yields: str, doubt: DataFrame) -> Column:
    """Whether *term* is one that yields a type in doubt. The table is one of ontology terms, which are few; those that
    type nothing in doubt, as a rule the ones of most rows, need not be read."""
    doubted = doubt.select(F.col("o").alias(yields)).distinct()
    return F.col(term).isin([r[0] for r in table.join(doubted, yields, "left_semi").select(term).distinct().collect()])


def revise_subclasses(old: DataFrame, fresh: DataFrame, known: DataFrame, change: Change, vocab: Vocab) -> Revision:
    """Types of superclasses."""
    def classes(graph):
        return closure.transitive_pairs(pattern(graph, "child", v.SUBCLASS_OF, "parent")).withColumnRenamed("node", "class")

    def types(graph):
        return pattern(graph, "s", v.TYPE, "class")

    def rows(typed):
        return iri_rows(typed, "s", v.TYPE, "ancestor")

    after = classes(fresh)
    touched = scan(change.gone.unionByName(change.new), p=v.SUBCLASS_OF)
    before = after if touched.isEmpty() else classes(old)
    went, came = _changed(before, after)
    doubtful = _written(rows(types(change.gone).join(before, "class").unionByName(types(old).join(went, "class"))), "doubtful")
    doubt = doubtful.unionByName(scan(change.gone, p=v.TYPE))
    yielding = terms(after, "class", "ancestor", doubt)
    kept = within(rows(within(types(fresh).where(yielding), doubt, ["s"]).join(after, "class")), doubt, TRIPLE_COLUMNS)
    found = rows(types(change.new).join(after, "class").unionByName(types(fresh).join(came, "class")))
    return Revision(doubtful, kept.unionByName(found))


def revise_domains(old: DataFrame, fresh: DataFrame, known: DataFrame, change: Change, vocab: Vocab) -> Revision:
    """Types of the domains of used properties. A property has one domain, so another one may replace it."""
    def used(graph):
        return graph.select("s", "p")

    def rows(typed):
        return iri_rows(typed, "s", v.TYPE, "domain")

    before, after = cut_lineage(inference.domains(old), "domains"), cut_lineage(inference.domains(fresh), "domains")
    went, came = _changed(before, after)
    doubtful = _written(rows(used(change.gone).join(before, "p").unionByName(used(old).join(went, "p"))), "doubtful")
    doubt = doubtful.unionByName(scan(change.gone, p=v.TYPE))
    yielding = terms(after, "p", "domain", doubt)
    kept = within(rows(within(used(fresh).where(yielding), doubt, ["s"]).join(after, "p")), doubt, TRIPLE_COLUMNS)
    found = rows(used(change.new).join(after, "p").unionByName(used(fresh).join(came, "p")))
    return Revision(doubtful, kept.unionByName(found))


def revise_same_as(old: DataFrame, fresh: DataFrame, known: DataFrame, change: Change, vocab: Vocab) -> Revision:
    """Properties copied once across every link, in both directions."""
    carried = [c for c in TRIPLE_COLUMNS if c != "s"]

    def links(graph):
        pairs = inference.same_as_pairs(graph)
        return pairs.select(F.col("a").alias("s"), F.col("b").alias("target")).unionByName(
            pairs.select(F.col("b").alias("s"), F.col("a").alias("target")))

    def facts(graph):
        return graph.where(F.col("p") != v.SAME_AS)

    def copied(rows, over):
        """*over* are links of the change, or links cut down to it."""
        return join_written(rows, over, "s").select(F.col("target").alias("s"), *carried)

    def links_from(graph, rows):
        """Links of the subjects of *rows*, and maybe few others; they are joined with the rows again."""
        return cut_lineage(may_match(links(graph), rows, "s"), "links")

    went, came = cut_lineage(links(change.gone), "links"), cut_lineage(links(change.new), "links")
    doubtful = _written(
        copied(facts(change.gone), links_from(old, change.gone)).unionByName(copied(facts(old), went)), "doubtful")
    doubt = doubtful.unionByName(facts(change.gone))
    sources = cut_lineage(within(links(fresh), doubt.select(F.col("s").alias("target")), ["target"]), "links")
    kept = within(copied(facts(fresh).where(named_in(doubt)), sources), doubt, TRIPLE_COLUMNS)
    found = copied(facts(change.new), links_from(fresh, change.new)).unionByName(copied(facts(fresh), came))
    return Revision(doubtful, kept.unionByName(found))


def revise_migration(old: DataFrame, fresh: DataFrame, known: DataFrame, change: Change, vocab: Vocab) -> Revision:
    """Migration status and months: a status speaks of all dates of a species, so a touched species is done anew."""
    own = [vocab.has_observation, vocab.term("migrationStatus"), vocab.term("typicallyPresentInMonth")]
    both = change.gone.unionByName(change.new)
    dated = cut_lineage(pattern(both, "obs", vocab.term("observedOn"), "date").select("obs").distinct(), "dated")
    seen = cut_lineage(within(pattern(old.unionByName(change.new), "s", vocab.has_observation, "obs"), dated, ["obs"]), "seen")
    species = cut_lineage(
        both.where(F.col("p").isin(own)).select("s").unionByName(scan(both, p=v.TYPE, o=vocab.term("Species")).select("s"))
        .unionByName(seen.select("s")).distinct(), "touched")
    # few others may come with them, each with all of its facts, so what is concluded of it holds
    facts = cut_lineage(may_match(fresh.where(F.col("p").isin(*own, v.TYPE)), species, "s"), "facts")
    sightings = scan(facts, p=vocab.has_observation).select(F.col("o").alias("s"))
    dates = cut_lineage(may_match(scan(fresh, p=vocab.term("observedOn")), sightings, "s"), "dates")  # the rule reads it often
    return Revision(within(known, species, ["s"]), inference.migration_rule(facts.unionByName(dates), vocab))


REVISIONS = [revise_parents, revise_subclasses, revise_domains, revise_same_as, revise_migration]


def of_part(rows: DataFrame, step: int, vocab: Vocab) -> DataFrame:
    """Those of the *rows* whose predicate is one that the part of this step may hold."""
    migration = [vocab.term("migrationStatus"), vocab.term("typicallyPresentInMonth")]
    p = F.col("p")
    return rows.where([p == vocab.parent_taxon, p == v.TYPE, p == v.TYPE, p != v.SAME_AS, p.isin(migration)][step - 1])


# -- the whole ----------------------------------------------------------------

def update(
    parts: list[DataFrame], added: DataFrame | None = None, removed: DataFrame | None = None, vocab: Vocab = DEFAULT) -> Updated:
    """The parts of a reasoned graph after *removed* left the asserted triples and *added* joined them.

    *parts* are those of ``run_reasoner`` or of an earlier ``update``. A triple that is both removed and added stays;
    triples removed that were not asserted, and added that were, change nothing. A removed triple that a rule still
    yields stays in the graph, as an inferred one. The result equals a run over the changed triples, part by part.
    """
    asserted = parts[0]
    none = asserted.sparkSession.createDataFrame([], TRIPLE)
    new = _written(none if added is None else added, "added")
    gone = minus(_written(none if removed is None else removed, "removed"), new)
    gone = _written(held(asserted, cut_lineage(gone, "gone")), "gone")
    new = _known(cut_lineage(absent_from(asserted, new), "new"))

    change, changed, sizes = Change(gone, new), [], []

    def revised(part: DataFrame, less: DataFrame, more: DataFrame) -> DataFrame:
        sizes.append((less.count(), more.count()))
        part = without(part, less) if sizes[-1][0] else part
        return part.unionByName(more) if sizes[-1][1] else part

    changed.append(revised(asserted, gone, new))
    for step, revise in enumerate(REVISIONS, start=1):
        old, fresh, known = union(parts[:step]), union(changed), parts[step]
        doubtful, holding = revise(old, fresh, known, change, vocab)
        doubtful = _written(held(known, cut_lineage(doubtful, "doubtful")), "doubtful")
        holding = _written(holding, "holding")
        there = _written(held(known, of_part(change.new, step, vocab)), "there")
        less = _written(minus(doubtful, holding).unionByName(there), "less")
        more = _known(cut_lineage(absent_from(fresh.unionByName(known), holding), "more"))
        changed.append(revised(known, less, more))
        if step == len(REVISIONS):
            break
        if there.isEmpty() and change.gone.isEmpty() and doubtful.isEmpty():  # then files are read as they are
            change = Change(change.gone, change.new.unionByName(more))
        else:
            change = Change(
                _written(minus(minus(change.gone.unionByName(doubtful), holding), change.new), "gone"),
                _written(minus(change.new, there).unionByName(minus(more, change.gone)), "new"))
    rows = [(step, name, less, more) for step, (name, (less, more)) in enumerate(zip(["asserted", *RULE_NAMES], sizes))]
    report = asserted.sparkSession.createDataFrame(rows, "step int, rule string, n_gone long, n_new long")
    return Updated(changed, report)


def save_parts(parts: list[DataFrame], path: str) -> None:
    """Write the parts, each by predicate, to a new folder."""
    for step, part in enumerate(parts):
        write_graph(part, f"{path}/part-{step}", True)


def load_parts(spark: SparkSession, path: str) -> list[DataFrame]:
    return [read_graph(spark, f"{path}/part-{step}") for step in range(len(REVISIONS) + 1)]
