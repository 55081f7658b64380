"""Enrichment folds and their triples."""

from pyspark.sql import functions as F

from checks.q_ingest import SPECIES, land
from checks.registry import query
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import enrichment as en, taxonomy as tax
from fieldlark.plans import graph as plans
from fieldlark.session import scratch_path
from fieldlark.sources import landed

NUM = r"regexp_matches({0}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
LAST = "arg_max({0}, seq) filter ({0} is not null)"


def label(c: str) -> str:
    return f"case when {c} <> '' and not starts_with({c}, 'Q') then {c} end"


FOLDED = f"""select name, arg_min(item_label, seq) as label,
      {LAST.format(label('status_label'))} as iucn_status, {LAST.format(label('diel_label'))} as diel,
      cast({LAST.format("case when " + NUM.format('mass') + " then mass end")} as double) as mass_g,
      cast({LAST.format("case when " + NUM.format('wingspan') + " then wingspan end")} as double) as wingspan_mm,
      {LAST.format("nullif(gbif_id, '')")} as gbif_id, {LAST.format("nullif(ebird_id, '')")} as ebird_id,
      arg_min(regexp_extract(item, '[^/]*$'), seq) filter (contains(item, '/Q')) as wikidata_id
    from $trait_row group by name"""
VALUES = f"""select distinct name, trait, value from (
      select name, 'habitat' as trait, {label('habitat_label')} as value from $trait_row
      union all select name, 'range', {label('range_label')} from $trait_row) x where value is not null"""
INDEX = f"(select scientific_name, min(species) as species from ({SPECIES}) sp group by scientific_name)"
TRAITS = f"""
    select species as s, p, o from {INDEX} i join (
      select name, '@ONT@massGrams' as p, cast(mass_g as varchar) as o from ({FOLDED}) f
      union all select name, '@ONT@wingspanMm', cast(wingspan_mm as varchar) from ({FOLDED}) f
      union all select name, '@ONT@dielCycle', diel from ({FOLDED}) f
      union all select name, '@SAME@', '@WD@'||wikidata_id from ({FOLDED}) f
      union all select name, '@ONT@'||trait, value from ({VALUES}) vv) t on t.name = i.scientific_name
    where o is not null"""


def index(t):
    return tax.name_index(tax.species_nodes(t.taxonomy, V))


@query("fold_traits", FOLDED)
def _(t):
    return en.fold_traits(t.trait_row)


@query("trait_values", VALUES)
def _(t):
    return en.trait_values(t.trait_row)


@query("trait_triples", TRAITS)
def _(t):
    return en.trait_triples(en.fold_traits(t.trait_row), en.trait_values(t.trait_row), index(t), V).select("s", "p", "o")


@query("trait_report", f"""
    select count(*) as attempted, count(*) filter (not exists (select 1 from $graph g where g.s = x.s and g.p = x.p
      and g.o = x.o)) as added from ({TRAITS}) x""")
def _(t):
    offered = en.trait_triples(en.fold_traits(t.trait_row), en.trait_values(t.trait_row), index(t), V)
    return en.enrichment_report(t.graph, offered)


@query("trait_coverage", f"""
    select count(label) as label, count(iucn_status) as iucn_status, count(diel) as diel, count(mass_g) as mass_g,
      count(wingspan_mm) as wingspan_mm, count(wikidata_id) as wikidata_id from ({FOLDED}) f""")
def _(t):
    return en.coverage(
        en.fold_traits(t.trait_row), "label", "iucn_status", "diel", "mass_g", "wingspan_mm", "wikidata_id")


@query("trait_value_coverage", f"select trait, count(distinct name) as n from ({VALUES}) x group by trait")
def _(t):
    return en.value_coverage(en.trait_values(t.trait_row))


SLUG = "'Bird_'||lower(upper(event_type))||'_'||user_id"
SLUGS = f"""select slug, arg_max(scientific_name, seq) as name from (
      select *, (string_split(common_name_en, ' ')[1])||'_'||lower(string_split(common_name_en, ' ')[2])||'_'||
        string_split(common_name_en, ' ')[3] as slug from $picture_pair) x group by slug"""
PICTURES = f"""select name, arg_min(nullif(thumb, ''), seq) filter (nullif(thumb, '') is not null) as thumbnail,
      arg_min(case when starts_with(range_map, 'http') then range_map else '@COMMONS@'||range_map end, seq)
        filter (range_map is not null) as range_map,
      arg_min(item, seq) as dbpedia_uri
    from (select *, replace(item, '@DBR@', '') as slug from $picture_row) r join ({SLUGS}) s on s.slug = r.slug
    group by name"""


@query("slug_index", SLUGS)
def _(t):
    return en.slug_index(t.picture_pair)


@query("fold_pictures", PICTURES)
def _(t):
    return en.fold_pictures(t.picture_row, en.slug_index(t.picture_pair))


@query("picture_triples", f"""
    select species as s, p, o from {INDEX} i join (
      select name, '@ONT@thumbnailUrl' as p, thumbnail as o from ({PICTURES}) f
      union all select name, '@ONT@rangeMapUrl', range_map from ({PICTURES}) f
      union all select name, '@SAME@', dbpedia_uri from ({PICTURES}) f) t on t.name = i.scientific_name
    where o is not null""")
def _(t):
    pictures = en.fold_pictures(t.picture_row, en.slug_index(t.picture_pair))
    return en.picture_triples(pictures, index(t), V).select("s", "p", "o")


@query("name_pairs", "select species, scientific_name, common_name_en from $species")
def _(t):
    return en.name_pairs(t.graph, V)


@query("first_names", f"select scientific_name, species from {INDEX} i order by scientific_name limit 40")
def _(t):
    return en.first_names(index(t), 40)


@query("latest_assessment", """
    select species_key, coalesce(arg_min(assessment_id, seq) filter (latest), arg_min(assessment_id, seq)) as assessment_id
    from $assessment_row group by species_key""")
def _(t):
    return en.latest_assessment_of_rows(t.assessment_row, "species_key")


def lookups(t):
    """Each event as a lookup of one name with three assessments."""
    e = t.given("events")
    item = [
        F.struct(F.lit("2020").alias("year_published"), flag.alias("latest"), key.alias("assessment_id"))
        for flag, key in (
            (F.col("value") > 150, F.col("event_id") * 3), (F.col("event_type") == "click", F.col("event_id") * 3 + 1),
            (F.lit(None).cast("boolean"), F.col("event_id") * 3 + 2))]
    name = F.when(F.col("event_type") == "error", "Single").otherwise(F.concat(F.lit("Genus sp"), "event_id"))
    return e.select(name.alias("name"), F.array(*item).alias("assessments"))


@query("latest_of_list", """
    select name, assessment_id from (select 'Genus sp'||event_id as name, case when value > 150 then event_id * 3
        when event_type = 'click' then event_id * 3 + 1 else event_id * 3 end as assessment_id
      from {events} where event_type <> 'error') x where assessment_id <> 0""")
def _(t):
    return en.latest_assessment(lookups(t))


def assessments(t):
    """Each event as a nested assessment."""
    e = t.given("events")

    def said(text):
        return F.create_map(F.lit("en"), text, F.lit("fr"), F.lit("x"))

    kind, nothing = F.col("event_type"), F.lit(None).cast("string")
    n = F.col("event_id") % 3
    place = F.concat(kind, F.lit(" place"))
    habitat = F.struct(
        said(F.when(n == 0, "").otherwise(place)).alias("description"), F.lit("Suitable").alias("suitability"),
        nothing.alias("season"), F.when(n == 1, "Yes").alias("majorImportance"))
    threat = F.struct(
        said(F.concat(F.lit("threat "), n.cast("string"))).alias("description"), F.lit("Whole").alias("scope"),
        kind.alias("severity"), nothing.alias("timing"))
    system = F.struct(said(F.when(n != 2, "Marine")).alias("description"), nothing.alias("code"))
    return e.select(
        F.col("event_id").alias("assessment_id"),
        F.struct(F.upper(F.substring(kind, 1, 2)).alias("code"), said(kind).alias("description")).alias("red_list_category"),
        F.struct(nothing.alias("code"), said(F.when(n != 0, "Stable")).alias("description")).alias("population_trend"),
        F.struct(F.when(n == 2, "Nomadic").otherwise("").alias("movement_patterns"), nothing.alias("population_size"))
        .alias("supplementary_info"),
        F.array(habitat).alias("habitats"), F.array(threat).alias("threats"), F.array(system).alias("systems"))


FLAT = """select event_id as assessment_id, upper(substr(event_type, 1, 2)) as category,
      case when event_id % 3 <> 0 then 'Stable' end as population_trend,
      case when event_id % 3 = 2 then 'Nomadic' end as movement,
      case when event_id % 3 <> 0 then event_type||' place' end as habitat, event_id % 3 = 1 as major,
      'threat '||(event_id % 3) as threat, event_type as severity, case when event_id % 3 <> 2 then 'Marine' end as system
    from {events}"""


@query("flatten_assessment", f"""
    select assessment_id, category, population_trend, movement, habitat, case when habitat is not null then major end as major,
      threat, severity, system from ({FLAT}) f""")
def _(t):
    flat = en.flatten_assessment(assessments(t))
    return flat.select(
        "assessment_id", "category", "population_trend", "movement", F.get("habitats", F.lit(0))["name"].alias("habitat"),
        F.get("habitats", F.lit(0))["major"].alias("major"), F.get("threats", F.lit(0))["name"].alias("threat"),
        F.get("threats", F.lit(0))["severity"].alias("severity"), F.get("systems", F.lit(0)).alias("system"))


ASSESSED = f"""
    select species as s, p, o from $species i join (
      select assessment_id, '@ONT@iucnCategory' as p, category as o from ({FLAT}) f
      union all select assessment_id, '@ONT@populationTrend', population_trend from ({FLAT}) f
      union all select assessment_id, '@ONT@movementPattern', movement from ({FLAT}) f
      union all select assessment_id, '@ONT@iucnHabitat', habitat from ({FLAT}) f
      union all select assessment_id, '@ONT@threat', threat from ({FLAT}) f
      union all select assessment_id, '@ONT@system', system from ({FLAT}) f) t on i.ebird_code = 'c'||t.assessment_id
    where o is not null"""


@query("assessment_triples", ASSESSED)
def _(t):
    names = t.species.select(F.substring("ebird_code", 2, 20).cast("bigint").alias("assessment_id"), F.col("scientific_name").alias("name"))
    named = en.flatten_assessment(assessments(t)).join(names, "assessment_id")
    return en.assessment_triples(named, t.species.select("scientific_name", "species"), V).select("s", "p", "o")


def landed_batches(t, rows, variables):
    """Query results as they are landed: a file per batch of 200 rows, named in the order of the rows."""
    def cell(c):
        return F.struct(F.lit("literal").alias("type"), F.col(c).alias("value"), F.lit("").alias("datatype"))
    entries = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(key), cell(c))) for key, c in variables.items()])))
    batch = F.lpad(F.floor(F.col("seq") / 200).cast("string"), 9, "0").alias("batch")
    results = F.transform(F.array_sort(
        F.collect_list(F.struct("seq", entries.alias("b"))), lambda x, y: F.signum(x["seq"] - y["seq"]).cast("int")), lambda x: x["b"])
    path = scratch_path(t.spark, "bindings")
    rows.groupBy(batch).agg(F.to_json(F.struct(F.struct(results.alias("bindings")).alias("results"))).alias("value")).write.option(
        "maxRecordsPerFile", 1).partitionBy("batch").text(path)
    return path


@query("landed_trait_bindings", """
    select name, item_label, habitat_label, status_label, range_label, diel_label, mass, wingspan from $trait_row""")
def _(t):
    rows = landed.read_trait_bindings(t.spark, landed_batches(t, t.trait_row, en.TRAIT_VARIABLES))
    return rows.select("name", "item_label", "habitat_label", "status_label", "range_label", "diel_label", "mass", "wingspan")


@query("landed_picture_bindings", "select item, thumb, range_map from $picture_row")
def _(t):
    rows = landed.read_picture_bindings(t.spark, landed_batches(t, t.picture_row, en.PICTURE_VARIABLES))
    return rows.select("item", "thumb", "range_map")


@query("enriched_with_traits", TRAITS.replace(
    INDEX, "(select scientific_name, min(species) as species from $species group by scientific_name)"))
def _(t):
    """From landed files and the graph to the triples they offer."""
    bindings = landed.read_trait_bindings(t.spark, landed_batches(t, t.trait_row, en.TRAIT_VARIABLES))
    return plans.enrich_with_traits(t.graph, bindings, V).select("s", "p", "o")


@query("enriched_with_pictures", """
    select species as s, p, o from (
      select species, '@ONT@thumbnailUrl' as p, thumbnail as o from $species
      union all select species, '@ONT@rangeMapUrl', range_map from $species
      union all select species, '@SAME@', '@DBR@'||common_name_en from $species) x where o is not null""")
def _(t):
    """One landed picture per species, under the page of its English name."""
    rows = t.species.select(
        F.substring("ebird_code", 2, 20).cast("bigint").alias("seq"), F.concat(F.lit(v.DBPEDIA_RESOURCE), "common_name_en").alias("item"),
        F.col("thumbnail").alias("thumb"), "range_map")
    bindings = landed.read_picture_bindings(t.spark, landed_batches(t, rows, en.PICTURE_VARIABLES))
    return plans.enrich_with_pictures(t.graph, bindings, V).select("s", "p", "o")


@query("enriched_with_assessments", ASSESSED + " and t.assessment_id <> 0")  # 0 counts as no id
def _(t):
    """One landed lookup per species, and the landed assessments."""
    item = F.struct(
        F.lit("2020").alias("year_published"), F.lit(True).alias("latest"),
        F.substring("ebird_code", 2, 20).cast("bigint").alias("assessment_id"))
    names = t.species.select(
        F.struct(F.col("scientific_name").alias("scientific_name")).alias("taxon"), F.array(item).alias("assessments"))
    return plans.enrich_with_assessments(
        t.graph, landed.read_iucn_lookups(t.spark, land(t, names, "lookups")),
        landed.read_iucn_assessments(t.spark, land(t, assessments(t), "assessments")), vocab=V).select("s", "p", "o")
