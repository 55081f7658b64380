"""Inference rules. Each takes a graph and returns the triples it adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.functions import migration
from fieldlark.model import vocab as v
from fieldlark.model.ontology import CLASSES
from fieldlark.model.types import TRIPLE_COLUMNS
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators import closure
from fieldlark.operators.grouping import distinct_rows, shuffled
from fieldlark.operators.joins import join_written, may_match, spread_join
from fieldlark.operators.triples import (
    entity_table, exists, instances, is_canonical, not_exists, pattern, scan,
)
from fieldlark.session import cut_lineage


def iri_rows(rows: DataFrame, s: str, p: str, o: str) -> DataFrame:
    return rows.select(
        F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"), F.lit("iri").alias("o_kind"),
        F.lit("").alias("o_lang"), F.lit("").alias("o_datatype"))


def not_there(wanted: DataFrame, there: DataFrame, few: bool = False) -> DataFrame:
    """The distinct rows of *wanted* that are not in *there*, a table of about that size at most; *few* says that both
    hold few rows, which are not spread over all partitions.

    Both are counted together, so that neither is sorted: IRIs begin alike, and every comparison would read most of them.
    """
    both = wanted.withColumn("_there", F.lit(False)).unionByName(there.withColumn("_there", F.lit(True)))
    found = (both if few else shuffled(both, *wanted.columns)).groupBy(*wanted.columns).agg(F.bool_or("_there").alias("_there"))
    return found.where("not _there").drop("_there")


def missing_links(triples: DataFrame, rows: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """``missing_from`` for the links *p* from column *s* to column *o*: only these two columns are shuffled."""
    wanted = rows.select(F.col(s).alias("s"), F.col(o).alias("o")).where("s is not null and o is not null")
    there = scan(triples, p=p).where("o_kind = 'iri' and o_lang = '' and o_datatype = ''").select("s", "o")
    return iri_rows(not_there(wanted, there), "s", p, "o")


def parent_edges(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    return pattern(triples, "child", vocab.parent_taxon, "parent")


def transitive_parents(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Links to every ancestor that is not linked directly."""
    pairs = closure.transitive_pairs(parent_edges(triples, vocab))
    return missing_links(triples, pairs, "node", vocab.parent_taxon, "ancestor")


def subclass_types(triples: DataFrame) -> DataFrame:
    """Types of all superclasses: the subclass table is closed first, then joined once."""
    edges = pattern(triples, "child", v.SUBCLASS_OF, "parent")
    pairs = closure.transitive_pairs(edges).withColumnRenamed("node", "class")
    typed = spread_join(pattern(triples, "s", v.TYPE, "class"), pairs, "class")
    # most nodes are of classes that are above no other
    above = exists(triples, pairs.select(F.col("ancestor").alias("o")))
    return missing_links(above, typed, "s", v.TYPE, "ancestor")


def domains(triples: DataFrame) -> DataFrame:
    """(p, domain) of the declared properties, the least domain of each."""
    declared = scan(triples, p=v.TYPE).where(
        F.col("o").isin(v.OWL + "DatatypeProperty", v.OWL + "ObjectProperty")).select("s").distinct()
    return (
        scan(triples, p=v.DOMAIN).join(declared, "s", "left_semi")
        .groupBy(F.col("s").alias("p")).agg(F.min("o").alias("domain"))
    )


def domain_types(triples: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """The domain class of every property a subject uses; one domain per declared property.

    Properties in *exclude* type nothing; use it to keep, say, observations that carry a
    scientific name from becoming taxa.
    """
    declared = domains(triples)
    if exclude:
        declared = declared.where(~F.col("p").isin(exclude))
    # ontology terms are few, and a shuffle by predicate would move the whole graph to a few tasks
    used = triples.select("s", "p").join(F.broadcast(declared), "p")
    return missing_links(triples, used, "s", v.TYPE, "domain")


def same_as_pairs(triples: DataFrame) -> DataFrame:
    return pattern(triples, "a", v.SAME_AS, "b")


def same_as_one_hop(triples: DataFrame) -> DataFrame:
    """Properties copied once across every owl:sameAs link, in both directions at the same time."""
    pairs = same_as_pairs(triples)
    both = cut_lineage(distinct_rows(pairs.select(F.col("a").alias("s"), F.col("b").alias("target")).unionByName(
        pairs.select(F.col("b").alias("s"), F.col("a").alias("target")))), "links")
    carried = [c for c in TRIPLE_COLUMNS if c != "s"]
    facts = triples.where(F.col("p") != v.SAME_AS)
    # most of a graph is about nodes without a link: such rows are dropped where they are read
    copied = join_written(facts, both, "s").select(F.col("target").alias("s"), *carried)
    return not_there(copied.select(*TRIPLE_COLUMNS), may_match(facts, both, "s").select(*TRIPLE_COLUMNS))


def same_as_components(triples: DataFrame) -> DataFrame:
    """Every linked node with the name of its group of equal nodes."""
    return closure.components(same_as_pairs(triples))


def same_as_merged(members: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal nodes after the triples *added* came, and the nodes whose group is new or has another name."""
    return closure.merge_components(members, same_as_pairs(added))


def component_properties(triples: DataFrame, members: DataFrame) -> DataFrame:
    """Properties of each group of equal nodes, held once per group.

    The full closure without writing the properties out for every member: join
    with *members* on ``component`` to look up one node.
    """
    carried = [c for c in TRIPLE_COLUMNS if c != "s"]
    members = cut_lineage(members.select(F.col("node").alias("s"), "component"), "members")
    return distinct_rows(join_written(triples.where(F.col("p") != v.SAME_AS), members, "s").select("component", *carried))


def species_months(facts: DataFrame) -> DataFrame:
    """Month mask per species over its dated observations (species, observed_on)."""
    return (
        facts.where(F.col("observed_on").isNotNull())
        .groupBy("species").agg(migration.month_mask(F.col("observed_on")).alias("months"))
    )


def migration_facts(facts: DataFrame, has_status: DataFrame | None = None, vocab: Vocab = DEFAULT) -> DataFrame:
    """(species, months mask, migration_status) of canonical species that have no status yet."""
    masks = species_months(facts.where(is_canonical(F.col("species"), vocab)))
    if has_status is not None:
        masks = not_exists(masks, has_status)
    return masks.withColumn("migration_status", migration.migration_class(F.col("months")))


def migration_triples(classified: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """One status triple and one triple per month, from one pass over *classified*."""
    def row(predicate: str, value: Column, datatype: str) -> Column:
        return F.struct(F.lit(predicate).alias("p"), value.cast("string").alias("o"), F.lit(datatype).alias("o_datatype"))

    status = row(vocab.term("migrationStatus"), F.col("migration_status"), "")
    months = F.transform(
        migration.mask_months(F.col("months")), lambda m: row(vocab.term("typicallyPresentInMonth"), m, v.INTEGER))
    return classified.select("species", F.explode(F.concat(F.array(status), months)).alias("t")).where("t.o is not null").select(
        F.col("species").alias("s"), "t.p", "t.o", F.lit("literal").alias("o_kind"), F.lit("").alias("o_lang"), "t.o_datatype")


def migration_rule(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Migration status and months from the observation dates in the graph."""
    species = instances(triples, vocab.term("Species"), "species")
    links = pattern(triples, "species", vocab.has_observation, "obs").where(is_canonical(F.col("species"), vocab))
    dates = pattern(triples, "obs", vocab.term("observedOn"), "date")
    dated = links.join(dates.hint("merge"), "obs").select(
        "species", F.substring("date", 1, 10).try_cast("date").alias("observed_on"))
    known = pattern(triples, "species", vocab.term("migrationStatus"), "status").select("species")
    classified = exists(migration_facts(dated, known, vocab), species)
    there = triples.where(F.col("p").isin(vocab.term("migrationStatus"), vocab.term("typicallyPresentInMonth")))
    # one row a species, so no triple comes twice
    return migration_triples(classified, vocab).join(there, TRIPLE_COLUMNS, "left_anti").select(*TRIPLE_COLUMNS)


def class_counts(triples: DataFrame, vocab: Vocab = DEFAULT, alias: str = "n") -> DataFrame:
    """Instances of each class of the ontology that occurs."""
    wanted = [vocab.term(name) for name, _, _ in CLASSES]
    return (
        scan(triples, p=v.TYPE).where(F.col("o").isin(wanted)).groupBy(F.col("o").alias("class"))
        .agg(F.count_distinct("s").alias(alias))
    )


def class_counts_diff(before: DataFrame, after: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Instances per class in two graphs and the number inferred between them."""
    both = class_counts(before, vocab, "n_before").join(class_counts(after, vocab, "n_after"), "class", "full")
    n_before, n_after = F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))
    return both.select(
        "class", n_before.alias("n_before"), n_after.alias("n_after"), (n_after - n_before).alias("inferred"))


def ancestor_report(triples: DataFrame, species: str, vocab: Vocab = DEFAULT) -> DataFrame:
    """Type and scientific name of everything one species is linked to as parent."""
    ancestors = scan(triples, s=species, p=vocab.parent_taxon).select(F.col("o").alias("ancestor"))
    described = exists(triples, ancestors.withColumnRenamed("ancestor", "s"))
    names = entity_table(described, {"type": v.TYPE, "scientific_name": v.SCIENTIFIC_NAME})
    return ancestors.join(names.withColumnRenamed("s", "ancestor"), "ancestor", "left").select(
        "ancestor", F.element_at(F.split("type", "/"), -1).alias("type"),
        F.coalesce("scientific_name", "ancestor").alias("name"))
