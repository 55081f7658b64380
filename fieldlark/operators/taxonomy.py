"""Taxonomy records to order, family, genus and species nodes.

Where several records describe one node, the one with the least ``seq`` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.functions import text
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators.grouping import distinct_rows, pick_first
from fieldlark.operators.triples import Fact, has_type, link, to_triples

# fixed values: predicate of a common name by language
NAME_PREDICATE = {"da": "commonNameDa", "fr": "commonNameFr", "en": "commonNameEn"}


def _scientific_name() -> Column:
    return F.coalesce(text.first_non_empty(F.col("sciName"), F.col("scientificName")), F.lit(""))


def _genus() -> Column:
    return text.non_empty(text.first_word(_scientific_name()))


def _iri(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key)


def order_nodes(records: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Distinct orders of all records."""
    return (
        records.select(F.col("order").alias("scientific_name"))
        .where(F.col("scientific_name") != "")
        .distinct()
        .select(
            _iri(vocab.taxon("order/"), text.iri_slug(F.col("scientific_name"))).alias("node"),
            "scientific_name", F.col("scientific_name").alias("common_name_en"))
    )


def family_nodes(records: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Distinct families; the first record names the family and its order."""
    rows = records.where(F.col("familySciName") != "").select(
        F.col("familySciName").alias("scientific_name"),
        text.non_empty(F.col("familyComName")).alias("common_name_en"),
        text.non_empty(F.col("order")).alias("order_name"), "seq")
    return pick_first(rows, ["scientific_name"], [F.col("seq")]).select(
        _iri(vocab.taxon("family/"), text.iri_slug(F.col("scientific_name"))).alias("node"),
        "scientific_name", "common_name_en",
        _iri(vocab.taxon("order/"), text.iri_slug(F.col("order_name"))).alias("parent"))


def genus_nodes(records: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Genera of species records, with or without a code; the first record gives the family."""
    rows = records.where(F.col("category") == "species").select(
        _genus().alias("genus"), text.non_empty(F.col("familySciName")).alias("family"), "seq",
    ).where(F.col("genus").isNotNull())
    return pick_first(rows, ["genus"], [F.col("seq")]).select(
        _iri(vocab.taxon("genus/"), text.iri_slug(F.col("genus"))).alias("node"), "genus",
        _iri(vocab.taxon("family/"), text.iri_slug(F.col("family"))).alias("parent"))


def species_nodes(records: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Species records that have a code, one row per record."""
    rows = records.where((F.col("category") == "species") & (F.col("speciesCode") != ""))
    return rows.select(
        _iri(vocab.taxon("species/"), F.col("speciesCode")).alias("species"),
        F.col("speciesCode").alias("ebird_code"),
        _scientific_name().alias("scientific_name"),
        F.coalesce(F.col("comName"), F.lit("")).alias("common_name"),
        _genus().alias("genus"),
        text.non_empty(F.col("familySciName")).alias("family"),
        text.non_empty(F.col("order")).alias("order_name"),
        F.col("taxonOrder").alias("taxon_order"),
        _iri(vocab.taxon("genus/"), text.iri_slug(_genus())).alias("parent"),
        _iri(v.EBIRD_SPECIES, F.col("speciesCode")).alias("same_as"))


def taxonomy_triples(records: DataFrame, locale: str = "en", vocab: Vocab = DEFAULT) -> DataFrame:
    """All nodes of a taxonomy as triples. Common names are Danish unless *locale* is 'en'."""
    return distinct_rows(taxonomy_facts(records, locale, vocab))


def taxonomy_facts(records: DataFrame, locale: str = "en", vocab: Vocab = DEFAULT) -> DataFrame:
    """The same before duplicates are removed, for plans that remove them once at the end."""
    name = vocab.term("commonNameEn" if locale == "en" else "commonNameDa")
    node, sci = F.col("node"), F.col("scientific_name")
    orders = to_triples(order_nodes(records, vocab), [
        has_type(node, vocab.term("Order")),
        Fact(node, v.SCIENTIFIC_NAME, sci),
        Fact(node, vocab.term("commonNameEn"), F.col("common_name_en")),
    ])
    families = to_triples(family_nodes(records, vocab), [
        has_type(node, vocab.term("Family")),
        Fact(node, v.SCIENTIFIC_NAME, sci),
        Fact(node, vocab.term("commonNameEn"), F.col("common_name_en")),
        link(node, vocab.parent_taxon, F.col("parent")),
    ])
    genera = to_triples(genus_nodes(records, vocab), [
        has_type(node, vocab.term("Genus")),
        Fact(node, v.GENUS, F.col("genus")),
        Fact(node, v.SCIENTIFIC_NAME, F.col("genus")),
        link(node, vocab.parent_taxon, F.col("parent")),
    ])
    sp = F.col("species")
    species = to_triples(species_nodes(records, vocab), [
        has_type(sp, vocab.term("Species")),
        Fact(sp, vocab.term("eBirdCode"), F.col("ebird_code")),
        Fact(sp, v.SCIENTIFIC_NAME, sci),
        Fact(sp, name, F.col("common_name")),
        link(sp, vocab.parent_taxon, F.col("parent")),
        Fact(sp, v.GENUS, F.col("genus")),
        Fact(sp, v.FAMILY, F.col("family")),
        Fact(sp, v.ORDER, F.col("order_name")),
        Fact(sp, vocab.term("taxonOrder"), text.number_text(F.col("taxon_order")), datatype=v.DECIMAL),
        link(sp, v.SAME_AS, F.col("same_as")),
    ])
    return orders.unionByName(families).unionByName(genera).unionByName(species)


def localized_name_triples(records: DataFrame, locale: str, vocab: Vocab = DEFAULT) -> DataFrame:
    """Language-tagged common names of species; da, fr and en are known."""
    if locale not in NAME_PREDICATE:
        raise ValueError(f"unsupported locale {locale!r}, known are {sorted(NAME_PREDICATE)}")
    rows = records.where(
        (F.col("category") == "species") & (F.col("speciesCode") != "") & (F.col("comName") != ""))
    species = _iri(vocab.taxon("species/"), F.col("speciesCode"))
    return to_triples(
        rows, [Fact(species, vocab.term(NAME_PREDICATE[locale]), F.col("comName"), lang=locale)]).distinct()


def danish_name_triples(records: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    return localized_name_triples(records, "da", vocab)


def name_index(names: DataFrame) -> DataFrame:
    """Scientific name to species; of several species with one name the least is taken."""
    return (
        names.where(F.col("scientific_name").isNotNull())
        .groupBy("scientific_name").agg(F.min("species").alias("species"))
    )
