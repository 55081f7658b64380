"""Traits from linked sources: fold the bindings per name, then attach them to species.

Every fold is an aggregate ordered by ``seq``, the position of a row in its source;
``seq`` may be a number or a struct of (file, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.functions import text
from fieldlark.model import vocab as v
from fieldlark.model.types import TRIPLE_COLUMNS
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators.joins import spread_join
from fieldlark.operators.triples import Fact, link, missing_from, to_triples

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# fixed values: variables of a trait query and of a picture query
TRAIT_VARIABLES = {
    "name": "name", "item": "item", "itemLabel": "item_label", "habitatLabel": "habitat_label",
    "statusLabel": "status_label", "rangeLabel": "range_label", "dielLabel": "diel_label",
    "mass": "mass", "wingspan": "wingspan", "gbifID": "gbif_id", "ebirdID": "ebird_id",
}
PICTURE_VARIABLES = {"item": "item", "thumb": "thumb", "rangeMap": "range_map"}


def first_by(value: Column, seq: str = "seq") -> Column:
    """Aggregate: the earliest value that is present."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(seq)))


def last_by(value: Column, seq: str = "seq") -> Column:
    """Aggregate: the latest value that is present."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(seq)))


def number(raw: Column) -> Column:
    raw = text.strip(raw)
    return F.when(raw.rlike(NUMBER), raw.try_cast("double"))


def resolved_label(label: Column) -> Column:
    """A label, NULL when it is empty or starts with Q as unresolved ids do."""
    return F.when((label != "") & ~label.startswith("Q"), label)


def binding_columns(bindings: DataFrame, variables: dict[str, str]) -> DataFrame:
    """Rows (seq, b map) to one column per variable; an absent variable is NULL."""
    picked = [
        F.try_element_at("b", F.lit(key)).getField("value").alias(name) for key, name in variables.items()]
    return bindings.select("seq", *picked)


# -- traits by scientific name ----------------------------------------------

def fold_traits(rows: DataFrame, mass_factor: float = 1.0, wingspan_factor: float = 1.0) -> DataFrame:
    """Single-valued traits per name: ids and label first wins, the others last valid wins.

    The label is that of the first row even when it is missing there. The factors
    convert source units; the default keeps the number as delivered.
    """
    item_id = F.when(F.col("item").contains("/Q"), text.last_segment(F.col("item")))
    folded = rows.where(F.col("name") != "").groupBy("name").agg(
        F.min_by("item_label", "seq").alias("label"),
        last_by(resolved_label(F.col("status_label"))).alias("iucn_status"),
        last_by(resolved_label(F.col("diel_label"))).alias("diel"),
        last_by(number(F.col("mass"))).alias("mass_g"),
        last_by(number(F.col("wingspan"))).alias("wingspan_mm"),
        last_by(text.non_empty(F.col("gbif_id"))).alias("gbif_id"),
        last_by(text.non_empty(F.col("ebird_id"))).alias("ebird_id"),
        first_by(item_id).alias("wikidata_id"),
    )
    return folded.withColumns({
        "mass_g": F.col("mass_g") * F.lit(mass_factor),
        "wingspan_mm": F.col("wingspan_mm") * F.lit(wingspan_factor),
    })


def trait_values(rows: DataFrame) -> DataFrame:
    """Multi-valued traits as distinct (name, trait, value) rows.

    Kept as rows rather than arrays: a name may have any number of values.
    Sort by value for the list form.
    """
    values = F.explode(F.array(
        F.struct(F.lit("habitat").alias("trait"), resolved_label(F.col("habitat_label")).alias("value")),
        F.struct(F.lit("range").alias("trait"), resolved_label(F.col("range_label")).alias("value")),
    ))
    return (
        rows.where(F.col("name") != "").select("name", values.alias("t")).select("name", "t.trait", "t.value")
        .where(F.col("value").isNotNull()).distinct()
    )


def _with_species(rows: DataFrame, index: DataFrame, name: str) -> DataFrame:
    return spread_join(rows, index.withColumnRenamed("scientific_name", name), name)


def trait_triples(
    traits: DataFrame, values: DataFrame, index: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Mass, wingspan, activity, habitats, ranges and the entity link of matched species."""
    sp = F.col("species")
    single = to_triples(_with_species(traits, index, "name"), [
        Fact(sp, vocab.term("massGrams"), text.number_text(F.col("mass_g")), datatype=v.DECIMAL),
        Fact(sp, vocab.term("wingspanMm"), text.number_text(F.col("wingspan_mm")), datatype=v.DECIMAL),
        Fact(sp, vocab.term("dielCycle"), F.col("diel")),
        link(sp, v.SAME_AS, F.concat(F.lit(v.WIKIDATA_ENTITY), F.col("wikidata_id"))),
    ])
    of = {kind: F.when(F.col("trait") == kind, F.col("value")) for kind in ("habitat", "range")}
    multi = to_triples(_with_species(values, index, "name"), [
        Fact(sp, vocab.term("habitat"), of["habitat"]),
        Fact(sp, vocab.term("range"), of["range"]),
    ])
    return single.unionByName(multi)


# -- pictures by English name -----------------------------------------------

def name_pairs(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Least scientific and least English name of every species that has both."""
    english = vocab.term("commonNameEn")
    is_species = (F.col("p") == v.TYPE) & (F.col("o") == vocab.term("Species"))
    return (
        triples.where(is_species | F.col("p").isin(v.SCIENTIFIC_NAME, english)).groupBy("s").agg(
            F.min(F.when(F.col("p") == v.SCIENTIFIC_NAME, F.col("o"))).alias("scientific_name"),
            F.min(F.when(F.col("p") == english, F.col("o"))).alias("common_name_en"),
            F.max(is_species).alias("_is_species"))
        .where("_is_species and scientific_name is not null and common_name_en is not null")
        .select(F.col("s").alias("species"), "scientific_name", "common_name_en")
    )


def slug_index(pairs: DataFrame) -> DataFrame:
    """Slug of the English name to scientific name; with ``seq`` the last pair of a slug wins."""
    pick = F.max_by("scientific_name", "seq") if "seq" in pairs.columns else F.min("scientific_name")
    return (
        pairs.withColumn("slug", text.dbpedia_slug(F.col("common_name_en"))).where(F.col("slug") != "")
        .groupBy("slug").agg(pick.alias("name"))
    )


def fold_pictures(rows: DataFrame, slugs: DataFrame) -> DataFrame:
    """First thumbnail and first range map per name; rows of unknown slugs are dropped."""
    slug = F.replace(F.col("item"), F.lit(v.DBPEDIA_RESOURCE), F.lit(""))
    raw_map = text.non_empty(F.col("range_map"))
    url = F.when(raw_map.startswith("http"), raw_map).otherwise(F.concat(F.lit(v.COMMONS_FILE), raw_map))
    return (
        spread_join(rows.where(F.col("item") != "").withColumn("slug", slug), slugs, "slug")
        .groupBy("name").agg(
            first_by(text.non_empty(F.col("thumb"))).alias("thumbnail"),
            first_by(url).alias("range_map"),
            F.min_by("item", "seq").alias("dbpedia_uri"))
    )


def picture_triples(pictures: DataFrame, index: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    sp = F.col("species")
    return to_triples(_with_species(pictures, index, "name"), [
        Fact(sp, vocab.term("thumbnailUrl"), text.non_empty(F.col("thumbnail"))),
        Fact(sp, vocab.term("rangeMapUrl"), text.non_empty(F.col("range_map"))),
        link(sp, v.SAME_AS, text.non_empty(F.col("dbpedia_uri"))),
    ])


# -- Red List assessments ---------------------------------------------------

def latest_assessment(lookups: DataFrame) -> DataFrame:
    """Per looked-up name the first assessment flagged latest, else the first; names of one word drop."""
    listed = F.col("assessments")
    latest = F.get(F.filter(listed, lambda a: F.coalesce(a["latest"], F.lit(False))), F.lit(0))
    chosen = F.coalesce(latest["assessment_id"], F.get(listed, F.lit(0))["assessment_id"])
    return (
        lookups.where(F.size(text.words(F.col("name"))) >= 2)
        .select("name", chosen.alias("assessment_id")).where(F.col("assessment_id") != 0)
    )


def latest_assessment_of_rows(rows: DataFrame, key: str) -> DataFrame:
    """The same choice over flat rows (key, seq, latest, assessment_id)."""
    flagged = F.when(F.col("latest"), F.col("seq"))
    return rows.groupBy(key).agg(
        F.coalesce(F.min_by("assessment_id", flagged), F.min_by("assessment_id", "seq")).alias("assessment_id"))


def flatten_assessment(assessments: DataFrame) -> DataFrame:
    """Code, trend, movement and the described habitats, threats and systems of each assessment."""
    def described(items: Column) -> Column:
        return F.filter(items, lambda x: F.try_element_at(x["description"], F.lit("en")) != "")

    def english(x: Column) -> Column:
        return F.try_element_at(x["description"], F.lit("en"))

    habitats = F.transform(described(F.col("habitats")), lambda h: F.struct(
        english(h).alias("name"), h["suitability"].alias("suitability"), h["season"].alias("season"),
        F.coalesce(h["majorImportance"] == "Yes", F.lit(False)).alias("major")))
    threats = F.transform(described(F.col("threats")), lambda t: F.struct(
        english(t).alias("name"), t["scope"].alias("scope"), t["severity"].alias("severity"),
        t["timing"].alias("timing")))
    systems = F.transform(described(F.col("systems")), english)
    return assessments.select(
        "assessment_id",
        F.col("red_list_category.code").alias("category"),
        F.try_element_at("population_trend.description", F.lit("en")).alias("population_trend"),
        habitats.alias("habitats"), threats.alias("threats"),
        text.non_empty(F.col("supplementary_info.movement_patterns")).alias("movement"),
        systems.alias("systems"))


def assessment_triples(named: DataFrame, index: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Flattened assessments with their ``name`` to triples of matched species."""
    rows = _with_species(named, index, "name")
    sp = F.col("species")
    single = to_triples(rows, [
        Fact(sp, vocab.term("iucnCategory"), text.non_empty(F.col("category"))),
        Fact(sp, vocab.term("populationTrend"), text.non_empty(F.col("population_trend"))),
        Fact(sp, vocab.term("movementPattern"), F.col("movement")),
    ])
    lists = {
        "iucnHabitat": F.transform("habitats", lambda x: x["name"]),
        "threat": F.transform("threats", lambda x: x["name"]),
        "system": F.col("systems"),
    }

    def under(predicate: str, items: Column) -> Column:
        values = F.coalesce(items, F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.struct(F.lit(predicate).alias("p"), x.alias("o")))

    listed = F.explode(F.concat(*[under(vocab.term(term), items) for term, items in lists.items()]))
    multi = rows.select(F.col("species").alias("s"), listed.alias("t")).select(
        "s", "t.p", "t.o", F.lit("literal").alias("o_kind"), F.lit("").alias("o_lang"),
        F.lit("").alias("o_datatype"))
    return single.unionByName(multi)


# -- reports ----------------------------------------------------------------

def coverage(folded: DataFrame, *columns: str) -> DataFrame:
    """How many names have each attribute, in one pass."""
    return folded.agg(*[F.count_if(F.col(c).isNotNull()).alias(c) for c in columns])


def value_coverage(values: DataFrame) -> DataFrame:
    """How many names have at least one value of each multi-valued trait."""
    return values.groupBy("trait").agg(F.count_distinct("name").alias("n"))


def first_names(names: DataFrame, limit: int = 0) -> DataFrame:
    """The first *limit* names in name order; 0 keeps all."""
    return names.orderBy("scientific_name").limit(limit) if limit > 0 else names


def enrichment_report(triples: DataFrame, attempted: DataFrame) -> DataFrame:
    """One row: triples offered by an enrichment and those that are new to the graph."""
    offered = attempted.select(*TRIPLE_COLUMNS)
    new = missing_from(triples, offered)
    return offered.agg(F.count(F.lit(1)).alias("attempted")).withColumn(
        "added", new.agg(F.count(F.lit(1))).scalar())
