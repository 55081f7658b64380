"""Taxonomy and occurrence ingestion."""

from pyspark.sql import functions as F

from checks.registry import query
from fieldlark.functions import geo
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import occurrences as occ, taxonomy as tax
from fieldlark.operators.triples import union_graphs
from fieldlark.plans.graph import build_graph
from fieldlark.session import scratch_path
from fieldlark.sources import landed

SLUG = "trim(regexp_replace({0}, '[^A-Za-z0-9_-]', '_', 'g'), '_')"
GENUS = "string_split(sci_name, ' ')[1]"

ORDERS = f"""select distinct '@ORD@'||{SLUG.format('ord')} as node, ord as scientific_name, ord as common_name_en
    from $taxonomy_record where ord <> ''"""
FAMILIES = f"""select '@FAM@'||{SLUG.format('family_sci')} as node, family_sci as scientific_name,
      nullif(family_com, '') as common_name_en, '@ORD@'||{SLUG.format('ord')} as parent
    from (select *, row_number() over (partition by family_sci order by seq) as rn from $taxonomy_record
      where family_sci <> '') x where rn = 1"""
GENERA = f"""select '@GEN@'||{SLUG.format('genus')} as node, genus, '@FAM@'||{SLUG.format("nullif(family_sci, '')")} as parent
    from (select *, row_number() over (partition by genus order by seq) as rn
      from (select *, {GENUS} as genus from $taxonomy_record where category = 'species') y) x where rn = 1"""
SPECIES = f"""select '@SP@'||species_code as species, species_code as ebird_code, sci_name as scientific_name,
      com_name as common_name, {GENUS} as genus, nullif(family_sci, '') as family, ord as order_name, taxon_order,
      '@GEN@'||{SLUG.format(GENUS)} as parent, '@EBIRD@'||species_code as same_as
    from $taxonomy_record where category = 'species' and species_code <> ''"""


@query("order_nodes", ORDERS)
def _(t):
    return tax.order_nodes(t.taxonomy, V)


@query("family_nodes", FAMILIES)
def _(t):
    return tax.family_nodes(t.taxonomy, V)


@query("genus_nodes", GENERA)
def _(t):
    return tax.genus_nodes(t.taxonomy, V)


@query("species_nodes", SPECIES)
def _(t):
    return tax.species_nodes(t.taxonomy, V)


def stack(source: str, facts: list[tuple[str, str, str]]) -> str:
    return " union ".join(
        f"select {s} as s, '{p}' as p, {o} as o from ({source}) x where {o} is not null" for s, p, o in facts)


TAXA = " union ".join([
    stack(ORDERS, [("node", "@TYPE@", "'@ONT@Order'"), ("node", "@DWC@scientificName", "scientific_name"),
                   ("node", "@ONT@commonNameEn", "common_name_en")]),
    stack(FAMILIES, [("node", "@TYPE@", "'@ONT@Family'"), ("node", "@DWC@scientificName", "scientific_name"),
                     ("node", "@ONT@commonNameEn", "common_name_en"), ("node", "@ONT@parentTaxon", "parent")]),
    stack(GENERA, [("node", "@TYPE@", "'@ONT@Genus'"), ("node", "@DWC@genus", "genus"),
                   ("node", "@DWC@scientificName", "genus"), ("node", "@ONT@parentTaxon", "parent")]),
    stack(SPECIES, [("species", "@TYPE@", "'@ONT@Species'"), ("species", "@ONT@eBirdCode", "ebird_code"),
                    ("species", "@DWC@scientificName", "scientific_name"), ("species", "@ONT@commonNameEn", "common_name"),
                    ("species", "@ONT@parentTaxon", "parent"), ("species", "@DWC@genus", "genus"),
                    ("species", "@DWC@family", "family"), ("species", "@DWC@order", "order_name"),
                    ("species", "@ONT@taxonOrder", "cast(taxon_order as varchar)"), ("species", "@SAME@", "same_as")]),
])


@query("taxonomy_triples", TAXA)
def _(t):
    return tax.taxonomy_triples(t.taxonomy, "en", V).select("s", "p", "o")


NAMES = """select '@SP@'||species_code as s, '@ONT@commonName{1}' as p, com_name as o, '{0}' as o_lang from $localized_record
    where lang in ({2}) and category = 'species' and species_code <> '' and com_name <> ''"""


# locales of the graph, and the languages of the given documents that stand for them
LANGUAGES = {"da": ("de", "es"), "en": ("en",), "fr": ("fr",)}
ALL_NAMES = " union ".join(
    NAMES.format(locale, locale.title(), ", ".join(f"'{x}'" for x in langs)) for locale, langs in LANGUAGES.items())


@query("localized_names", ALL_NAMES)
def _(t):
    rows = [tax.localized_name_triples(t.localized(*langs), locale, V) for locale, langs in LANGUAGES.items()]
    return union_graphs(*rows).select("s", "p", "o", "o_lang")


INDEX = f"select scientific_name, min(species) as species from ({SPECIES}) sp group by scientific_name"


@query("name_index", INDEX)
def _(t):
    return tax.name_index(tax.species_nodes(t.taxonomy, V))


BINOMIAL = "array_to_string(string_split(o.scientific_name, ' ')[1:2], ' ')"
MINTED = "'@SP@sci/'||trim(regexp_replace(o.scientific_name, '[^A-Za-z0-9]', '_', 'g'), '_')"
RESOLVED = f"""select o.*, coalesce(i.species, {MINTED}) as species, i.species is null as is_minted
    from $occurrence_record o left join ({INDEX}) i on i.scientific_name = {BINOMIAL}"""


def resolved(t):
    return occ.resolve_species(t.occurrences, tax.name_index(tax.species_nodes(t.taxonomy, V)), V)


@query("resolve_species", f"select seq, species, is_minted from ({RESOLVED}) r")
def _(t):
    return resolved(t).select("seq", "species", "is_minted")


CODES = "(values ('CR', 0), ('EN', 1), ('VU', 2), ('NT', 3), ('LC', 4), ('DD', 5), ('NE', 6)) as codes(code, rank)"
WORST = f"""select species, arg_min(code, rank) as status from ({RESOLVED}) r
    join {CODES} on code = upper(trim(iucn_category)) group by species"""


@query("worst_status", WORST)
def _(t):
    return occ.worst_status(resolved(t))


COUNT = "case when regexp_matches(trim(individual_count), '^[+-]?[0-9]+$') then cast(individual_count as bigint) end"
LOC = "'@LOC@'||translate(printf('%.4f_%.4f', lat, lon), '-.', 'Np')"
FACTS = f"""select '@OBS@'||occ_key as obs_id, species, is_minted, scientific_name,
      try_cast(event_date as date) as observed_on, {COUNT} as individual_count, recorder as recorded_by,
      occ_key as gbif_key, case when lat is not null then {LOC} end as loc_id, lat,
      case when lat is not null then lon end as lon, case when lat is not null then locality end as locality,
      case when species_key <> 0 then '@GBIF@'||species_key end as same_as
    from ({RESOLVED}) r"""


@query("observation_rows", FACTS.replace("'@OBS@'||occ_key", "'@OBS@'||coalesce(case when occ_key <> 0 then occ_key::varchar end, "
       "substr(md5(scientific_name||event_date||coalesce(lat::varchar, 'None')||lon::varchar), 1, 12))").replace(
           "occ_key as gbif_key", "nullif(occ_key, 0) as gbif_key"))
def _(t):
    return occ.observations(resolved(t), V)


@query("digest_ids", """
    select seq, substr(md5(scientific_name||event_date||coalesce(lat::varchar, 'None')||lon::varchar), 1, 12) as obs_key
    from $occurrence_record""")
def _(t):
    without_key = t.occurrences.withColumn("key", F.lit(None).cast("bigint"))
    return without_key.select("seq", occ.observation_key().alias("obs_key"))


@query("dates_and_counts", f"""
    select seq, try_cast(event_date as date) as observed_on, {COUNT} as individual_count,
      case when species_key <> 0 then '@GBIF@'||species_key end as same_as
    from $occurrence_record""")
def _(t):
    rows = t.occurrences
    kind = rows.schema["individualCount"].dataType
    return rows.select(
        "seq", occ.observed_date().alias("observed_on"),
        occ.individual_count(F.col("individualCount"), kind).alias("individual_count"),
        F.concat(F.lit("https://www.gbif.org/species/"), occ.gbif_species_key()).alias("same_as"))


@query("grid_keys", """
    select seq, translate(printf('%.4f_%.4f', lat, lon), '-.', 'Np') as loc_key from $occurrence_record
    where lat is not null""")
def _(t):
    placed = t.occurrence_record.where("lat is not null")
    return placed.select("seq", geo.grid_key(F.col("lat"), F.col("lon")).alias("loc_key"))


@query("locations", f"""
    select loc_id, lat, lon, locality from (select *, row_number() over (partition by loc_id order by obs_id) as rn
      from (select '@OBS@'||seq as obs_id, {LOC} as loc_id, lat, lon, locality from $occurrence_record where lat is not null) y) x
    where rn = 1""")
def _(t):
    facts = t.occurrence_record.where("lat is not null").select(
        F.concat(F.lit(V.observation()), "seq").alias("obs_id"), "lat", "lon", "locality",
        F.concat(F.lit(V.location()), geo.grid_key(F.col("lat"), F.col("lon"))).alias("loc_id"))
    return occ.locations(facts)


@query("capped_newest_first", """
    with unique_rows as (select * from (select *, row_number() over (partition by occ_key order by yr desc, seq) as rn
        from $occurrence_record where occ_key <> 0) x where rn = 1),
      capped as (select * from (select *, row_number() over (partition by yr order by seq) as rk from unique_rows) y
        where rk <= 150)
    select seq, occ_key, yr from capped order by yr desc, seq limit 500""")
def _(t):
    return occ.capped_newest_first(t.occurrences, 500, year_cap=150).select(
        "seq", F.col("key").alias("occ_key"), F.col("year").alias("yr"))


OBS = "'@OBS@'||coalesce(case when occ_key <> 0 then occ_key::varchar end, substr(md5(scientific_name||event_date||coalesce(lat::varchar, 'None')||lon::varchar), 1, 12))"
KEYED = FACTS.replace("'@OBS@'||occ_key", OBS).replace("occ_key as gbif_key", "nullif(occ_key, 0) as gbif_key")
MADE = "case when is_minted then species end"
SEEN = stack(KEYED, [
    (MADE, "@TYPE@", f"case when {MADE} is not null then '@ONT@Species' end"),
    (MADE, "@DWC@scientificName", f"case when {MADE} is not null then scientific_name end"),
    ("obs_id", "@TYPE@", "'@ONT@Observation'"), ("obs_id", "@DWC@scientificName", "scientific_name"),
    ("obs_id", "@ONT@observedOn", "cast(observed_on as varchar)"),
    ("obs_id", "@ONT@individualCount", "cast(individual_count as varchar)"),
    ("obs_id", "@ONT@recordedBy", "recorded_by"), ("obs_id", "@ONT@gbifKey", "cast(gbif_key as varchar)"),
    ("loc_id", "@TYPE@", "case when loc_id is not null then '@ONT@Location' end"),
    ("loc_id", "@ONT@latitude", "cast(lat as varchar)"), ("loc_id", "@ONT@longitude", "cast(lon as varchar)"),
    ("loc_id", "@ONT@locality", "locality"), ("obs_id", "@ONT@observedAt", "loc_id"),
    ("species", "@ONT@hasObservation", "obs_id"), ("species", "@SAME@", "same_as"),
]) + f" union select species, '@ONT@conservationStatus', status from ({WORST}) w"


@query("occurrence_triples", SEEN)
def _(t):
    index = tax.name_index(tax.species_nodes(t.taxonomy, V))
    return occ.occurrence_triples(t.occurrences, index, V).select("s", "p", "o")


@query("build_graph", f"""
    select s, p, o, '' as o_lang from ({TAXA}) a union select s, p, o, '' from ({SEEN}) b
    union {ALL_NAMES}
    union select s, p, o, '' from $graph where s in (select s from $graph where p = '@TYPE@' and starts_with(o, '@OWL@'))""")
def _(t):
    graph = build_graph(t.taxonomy, {locale: t.localized(*langs) for locale, langs in LANGUAGES.items()}, t.occurrences, vocab=V)
    return graph.select("s", "p", "o", "o_lang")


def land(t, rows, label):
    path = scratch_path(t.spark, label)
    rows.write.json(path)
    return path


@query("landed_taxonomy", SPECIES)
def _(t):
    return tax.species_nodes(landed.read_taxonomy(t.spark, land(t, t.taxonomy, "taxonomy")), V)


@query("landed_occurrences", """
    select seq, yr, occ_key, scientific_name, event_date, lat, lon, locality, recorder,
      try_cast(individual_count as bigint) as individual_count
    from $occurrence_record where yr between 1994 and 1996""")
def _(t):
    """Every other count is a JSON number with a fraction, the others are texts."""
    rows = t.occurrences.withColumns({
        "datasetKey": F.lit(landed.DATASET_KEY), "basisOfRecord": F.lit(landed.BASIS_OF_RECORD)})
    count = F.col("individualCount")
    is_number = (F.col("seq") % 2 == 0) & (count != "many")
    shown = F.when(is_number, F.concat(count, F.lit(".7"))).otherwise(F.concat(F.lit('"'), count, F.lit('"')))
    record = F.to_json(F.struct(*[c for c in rows.columns if c not in ("individualCount", "year")]))
    line = F.concat(F.lit('{"individualCount":'), shown, F.lit(","), F.substring(record, F.lit(2), F.length(record)))
    path = scratch_path(t.spark, "occurrences")
    rows.select("year", line.alias("value")).write.partitionBy("year").text(path)
    read = landed.read_occurrences(t.spark, path, years=(1994, 1996))
    return read.select(
        "seq", F.col("year").alias("yr"), F.col("key").alias("occ_key"), F.col("scientificName").alias("scientific_name"),
        F.col("eventDate").alias("event_date"), F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon"),
        "locality", F.col("recordedBy").alias("recorder"),
        occ.individual_count(F.col("individualCount"), read.schema["individualCount"].dataType).alias("individual_count"))


@query("landed_names", ALL_NAMES)
def _(t):
    path = scratch_path(t.spark, "names")
    rows = t.localized_record.withColumnsRenamed({"species_code": "speciesCode", "com_name": "comName", "lang": "locale"})
    rows.write.partitionBy("locale").json(path)
    names = landed.read_localized_names(t.spark, path)
    return union_graphs(*[
        tax.localized_name_triples(names.where(F.col("locale").isin(*langs)), locale, V)
        for locale, langs in LANGUAGES.items()]).select("s", "p", "o", "o_lang")


@query("landed_sightings", """
    select "speciesCode" as code, "comName" as name, "obsDt" as seen, "locName" as place, lat, lng, "howMany" as n from $sighting""")
def _(t):
    rows = landed.read_sightings(t.spark, land(t, t.sighting, "sightings"))
    return rows.select(
        F.col("speciesCode").alias("code"), F.col("comName").alias("name"), F.col("obsDt").alias("seen"),
        F.col("locName").alias("place"), "lat", "lng", F.col("howMany").alias("n"))


@query("landed_counts", """
    select (select count(*) from $taxonomy_record) as taxonomy, (select count(*) from $localized_record) as names,
      (select count(*) from $sighting) as sightings""")
def _(t):
    """Readers asked for nothing but a count."""
    spark = t.spark
    read = [landed.read_taxonomy(spark, land(t, t.taxonomy, "taxonomy")),
            landed.read_localized_names(spark, land(t, t.localized_record.withColumnRenamed("species_code", "speciesCode"), "names")),
            landed.read_sightings(spark, land(t, t.sighting, "sightings"))]
    counts = [df.agg(F.count(F.lit(1))).scalar() for df in read]
    return spark.range(1).select(*[n.alias(c) for n, c in zip(counts, ("taxonomy", "names", "sightings"))])


@query("corrupt_lines", """
    select count(*) filter (event_type <> 'error') as n_valid, count(*) filter (event_type = 'error') as n_corrupt,
      count(*) filter (event_type = 'click') as n_empty
    from {events}""")
def _(t):
    path = scratch_path(t.spark, "lines")
    cut = F.when(F.col("event_type") == "error", F.regexp_replace("props", "}$", "")).when(
        F.col("event_type") == "click", "{}").otherwise(F.col("props"))
    t.given("events").select(cut).write.text(path)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.LongType())])
    return landed.input_report(landed.read_json(t.spark, path, schema))


@query("reader_report", """
    select 'bindings' as kind, 4 - count(*) filter (n % 4 = 0) as n_valid, count(*) filter (n % 4 = 0) as n_bad, 0 as n_empty,
      count(*) filter (n % 4 = 0) as n_bad_files from range(1, 5) r(n)
    union all
    select 'sightings', count(*) filter (event_id % 7 > 0), count(*) filter (event_id % 7 = 0),
      count(*) filter (event_id % 7 = 1), cast(count(*) filter (event_id % 7 = 0) > 0 as bigint) from {events}""")
def _(t):
    """Sightings with cut and with empty lines, and query results of which one file is cut."""
    lines = t.given("events").select(F.when(F.col("event_id") % 7 == 0, '{"speciesCode":').when(
        F.col("event_id") % 7 == 1, '{"other":1}').otherwise('{"speciesCode":"a"}').alias("value"))
    sightings, bindings = scratch_path(t.spark, "sightings"), scratch_path(t.spark, "bindings")
    lines.coalesce(1).write.text(sightings)
    files = t.spark.range(1, 5).select("id", F.when(F.col("id") % 4 == 0, '{"results":').otherwise(
        '{"results":{"bindings":[{"item":{"type":"uri","value":"x"}}]}}').alias("value"))
    files.repartition(4, "id").write.partitionBy("id").text(bindings)
    return landed.reader_report(t.spark, {"bindings": f"{bindings}/*", "sightings": sightings})
