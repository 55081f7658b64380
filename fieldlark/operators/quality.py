"""Data-quality checks. Each returns the offending rows or one row per measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.functions import text
from fieldlark.model import vocab as v
from fieldlark.model.ontology import classes, properties, subclass_of
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators.joins import spread_join
from fieldlark.operators.triples import entity_table, instances, not_exists, pattern, scan

# fixed values: lower limits of counts and shares, and limits of plausible values
MIN_COUNTS = {"Species": 10_000, "Observation": 0}
MIN_TRIPLES = 200_000
MIN_LINKS = {"wikidata_links": 1000, "wingspan": 100, "range": 1000, "diel": 100}
MIN_SHARE = {"scientific_name": 0.99, "common_name_en": 0.95, "observed_on": 0.95, "location": 0.95}
VALUE_RANGES = {"wingspan_mm": (5.0, 4000.0), "mass_grams": (0.5, 200_000.0)}


def undeclared_classes(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Classes of this vocabulary used as a type but not declared, with the number of uses."""
    used = (
        scan(triples, p=v.TYPE).where(F.col("o").startswith(vocab.term("")))
        .groupBy(F.col("o").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    )
    return not_exists(used, F.broadcast(classes(triples.sparkSession, vocab)).select("class"))


def missing_superclasses(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Subclass edges of the ontology that the graph does not hold."""
    held = pattern(triples, "sub", v.SUBCLASS_OF, "sup")
    return subclass_of(triples.sparkSession, vocab).join(held, ["sub", "sup"], "left_anti")


def undeclared_properties(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Predicates in use without a declared domain and range, with the number of uses.

    The terms of RDF, RDFS and OWL themselves need no declaration.
    """
    used = triples.groupBy(F.col("p").alias("prop")).agg(F.count(F.lit(1)).alias("n"))
    for space in (v.RDF, v.RDFS, v.OWL):
        used = used.where(~F.col("prop").startswith(space))
    declared = properties(triples.sparkSession, vocab).where("domain <> '' and range <> ''")
    return not_exists(used, F.broadcast(declared).select("prop"))


def minimum_counts(triples: DataFrame, limits: dict[str, int] = MIN_COUNTS, vocab: Vocab = DEFAULT) -> DataFrame:
    """Instances per class against a limit that must be exceeded."""
    counts = scan(triples, p=v.TYPE).agg(*[
        F.count_distinct(F.when(F.col("o") == vocab.term(cls), F.col("s"))).alias(cls) for cls in limits])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(cls).alias("measure"), F.col(cls).alias("n"), F.lit(limit).cast("bigint").alias("limit"),
                 (F.col(cls) > limit).alias("ok"))
        for cls, limit in limits.items()])).alias("r")).select("r.*")


def share_present(rows: DataFrame, **limits: float) -> DataFrame:
    """Share of rows in which each column is present, against a limit that must be exceeded.

    All shares come from one pass; an empty table has share 0.
    """
    measured = rows.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in limits])
    return measured.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("n_present"), F.col("_all").alias("n_all"),
                 F.coalesce(F.col(c) > F.col("_all") * F.lit(limit), F.lit(False)).alias("ok"))
        for c, limit in limits.items()])).alias("r")).select("r.*")


def species_shares(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    table = entity_table(
        triples, {"scientific_name": v.SCIENTIFIC_NAME, "common_name_en": vocab.term("commonNameEn")},
        vocab.term("Species"))
    return share_present(table, **{c: MIN_SHARE[c] for c in ("scientific_name", "common_name_en")})


def observation_shares(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    table = entity_table(
        triples, {"observed_on": vocab.term("observedOn"), "location": vocab.term("observedAt")},
        vocab.term("Observation"))
    return share_present(table, **{c: MIN_SHARE[c] for c in ("observed_on", "location")})


def blank_names(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Species with a scientific name of white space only."""
    names = pattern(triples, "species", v.SCIENTIFIC_NAME, "name").where(text.strip(F.col("name")) == "")
    return names.join(instances(triples, vocab.term("Species"), "species"), "species", "left_semi")


def link_counts(triples: DataFrame, limits: dict[str, int] = MIN_LINKS, vocab: Vocab = DEFAULT) -> DataFrame:
    """Entity links and trait values in one pass, against limits that must be exceeded."""
    p = F.col("p")
    tests: dict[str, Column] = {
        "wikidata_links": (p == v.SAME_AS) & F.col("o").contains("wikidata.org"),
        "wingspan": p == vocab.term("wingspanMm"),
        "range": p == vocab.term("range"),
        "diel": p == vocab.term("dielCycle"),
    }
    counts = triples.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).alias("n"),
                 F.lit(limits[name]).cast("bigint").alias("limit"), (F.col(name) > limits[name]).alias("ok"))
        for name in tests])).alias("r")).select("r.*")


def range_violations(rows: DataFrame, key: str, ranges: dict[str, tuple[float, float]] = VALUE_RANGES) -> DataFrame:
    """Present values outside their closed range, as (key, measure, value)."""
    known = {c: limits for c, limits in ranges.items() if c in rows.columns}
    bad = F.array(*[
        F.struct(F.lit(c).alias("measure"),
                 F.when(~F.col(c).between(*limits), F.col(c)).alias("value"))
        for c, limits in known.items()])
    return rows.select(key, F.explode(bad).alias("r")).select(key, "r.measure", "r.value").where(
        F.col("value").isNotNull())


def triple_total(triples: DataFrame, limit: int = MIN_TRIPLES) -> DataFrame:
    return triples.agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("n") > limit)


def dangling_references(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Links of the object properties whose target is the subject of nothing."""
    links = triples.where(
        F.col("p").isin([vocab.term(x) for x in ("parentTaxon", "hasObservation", "observedAt")]))
    subjects = triples.select(F.col("s").alias("o")).distinct()
    return spread_join(links, subjects, "o", "left_anti").select("s", "p", "o")
