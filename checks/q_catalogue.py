"""The query catalogue and its scalar functions on the given tables."""

from pyspark.sql import functions as F

from checks.registry import query
from fieldlark.functions import geo, migration, status, text
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import extracts, inference, queries
from fieldlark.operators.inference import migration_facts, species_months

KM = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 55.6918) / 2), 2)
    + cos(radians(55.6918)) * cos(radians(lat)) * pow(sin(radians(lon - 12.5559) / 2), 2))))"""
RANK = """case {0} when 'CR' then 0 when 'EN' then 1 when 'VU' then 2 when 'NT' then 3 when 'LC' then 4
    when 'DD' then 5 when 'NE' then 6 else 999 end"""
NEAR = f"""
    with latest as (
      select *, row_number() over (partition by species order by observed_on desc nulls last, obs_id) as rn
      from $observation where {KM} <= 25)
    select l.species, obs_id, observed_on, individual_count, locality, lat, lon, scientific_name, common_name_en,
      common_name_da, common_name_fr, status, {RANK.format('status')} as rank
    from latest l join $species s on s.species = l.species where rn = 1"""

# the two folds in SQL
COMPAT = "lower(replace(translate({0}, 'éèêëàâäùûüîïôöçøå', 'eeeeaaauuuiioocoa'), 'æ', 'ae'))"
FULL = ("lower(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(translate({0}, "
        "'øØåÅðÐ', 'oOaAdD'), 'æ', 'ae'), 'Æ', 'ae'), 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'oe'), 'þ', 'th'), 'Þ', 'th')), "
        "'[^\\x00-\\x7F]', '', 'g'))")
NAME_COLUMNS = ["scientific_name", "common_name_en", "common_name_da", "common_name_fr"]


def name_condition(fold: str, typed: str, plain: str, columns=NAME_COLUMNS) -> str:
    return " or ".join(
        f"contains(lower({c}), '{typed}') or contains({fold.format(c)}, '{plain}')" for c in columns)


@query("nearby_watch", NEAR)
def _(t):
    return queries.nearby_watch(t.species, t.observation, radius_km=25.0)


@query("nearby_threatened", f"""
    select count(*) as n from ({NEAR}) as near where status in ('CR', 'EN', 'VU', 'NT')""")
def _(t):
    return queries.threatened_count(queries.nearby_watch(t.species, t.observation, radius_km=25.0))


def find_sql(fold, typed, plain):
    return f"""
    select distinct s.species, scientific_name, common_name_en, common_name_da, common_name_fr, ebird_code, thumbnail,
      range_map, mass_grams, wingspan_mm, habitat, status, migration_status
    from $named_species s left join $habitat h on h.species = s.species
    where {name_condition(fold, typed, plain)}
    order by scientific_name nulls first, s.species, habitat nulls first limit 50"""


@query("find_by_name_compat", find_sql(COMPAT, "réê", "ree"))
def _(t):
    return queries.find_species_by_name(t.named_species, t.habitat, "Réê", limit=queries.NAME_LIMIT)


@query("find_by_name_full", find_sql(FULL, "elle eau", "elle eau"))
def _(t):
    return queries.find_species_by_name(t.named_species, t.habitat, "elle eau", fold="full", limit=queries.NAME_LIMIT)


@query("folded_names", f"""
    select species, {COMPAT.format('common_name_fr')} as compat, {FULL.format('common_name_fr')} as whole,
      contains({FULL.format('common_name_fr')}, 'ere') as has_ere
    from $named_species""")
def _(t):
    name = F.col("common_name_fr")
    return t.named_species.select(
        "species", text.fold_compat(name).alias("compat"), text.fold_full(name).alias("whole"),
        text.name_matches(name, "ÈRE").alias("has_ere"))


@query("observed_species", """
    select distinct species, scientific_name, common_name_en, common_name_da, common_name_fr from $species
    where species in (select species from $observation)""")
def _(t):
    return queries.list_observed_species(t.species, t.observation)


@query("species_by_family", """
    select distinct species, scientific_name, common_name_en, common_name_da, ebird_code, thumbnail
    from $species where contains(lower(family), 'family1')""")
def _(t):
    return queries.species_by_family(t.species, "FAMILY1")


@query("species_by_order", """
    select distinct species, scientific_name, common_name_en, family
    from $species where contains(lower(order_name), 'order2')""")
def _(t):
    return queries.species_by_order(t.species, "Order2")


RECENT = """
    select r.species, obs_id, observed_on, individual_count, locality, lat, lon, scientific_name, common_name_en,
      common_name_da, common_name_fr
    from (select o.* from $observation o where species in (select species from $species {0})
      order by observed_on desc, obs_id limit 100) r
    left join $species s on s.species = r.species"""


@query("recent_observations", RECENT.format(""))
def _(t):
    return queries.recent_observations(t.species, t.observation, limit=queries.RECENT_LIMIT)


@query("recent_observations_named", RECENT.format("where " + name_condition(COMPAT, "a machin", "a machin")))
def _(t):
    return queries.recent_observations(t.species, t.observation, "À machin", fold="compat", limit=queries.RECENT_LIMIT)


MONTHS = "(select distinct species, month(observed_on) as m from $observation where observed_on is not null)"


@query("present_in_month", f"""
    select distinct s.species, scientific_name, common_name_en, common_name_da, common_name_fr, ebird_code, status,
      migration_status
    from $species s join {MONTHS} o on o.species = s.species where m = 6""")
def _(t):
    months = species_months(t.observation).select(
        "species", F.explode(migration.mask_months(F.col("months"))).alias("month"))
    return queries.currently_present(t.species, months, 6)


CLASS = """case when len(ms) = 0 then 'Unknown' when len(ms) >= 9 then 'Resident'
    when list_has_any(ms, [5, 6, 7]) and list_has_any(ms, [12, 1, 2]) then 'PartialMigrant'
    when list_has_any(ms, [5, 6, 7]) then 'SummerVisitor' when list_has_any(ms, [12, 1, 2]) then 'WinterVisitor'
    else 'PassageMigrant' end"""
CLASSED = f"""select species, ms, {CLASS} as migration_status
    from (select species, list(m order by m) as ms from {MONTHS} x group by species) y"""


@query("migration_status", f"""
    select species, array_to_string(ms, ',') as months, migration_status from ({CLASSED}) z
    where species not in (select species from $species where migration_status is not null)""")
def _(t):
    known = t.species.where("migration_status is not null").select("species")
    return migration_facts(t.observation, known).select(
        "species", F.array_join(migration.mask_months(F.col("months")), ",").alias("months"), "migration_status")


@query("likely_present", f"""
    select species, cast(m as int) as month, migration_status,
      case migration_status when 'SummerVisitor' then m in (4, 5, 6, 7, 8, 9)
        when 'WinterVisitor' then m in (10, 11, 12, 1, 2, 3) when 'PassageMigrant' then m in (3, 4, 5, 9, 10)
        else true end as present,
      case migration_status when 'Resident' then '🏠 Resident' when 'SummerVisitor' then '☀️  Summer visitor'
        when 'WinterVisitor' then '❄️  Winter visitor' when 'PassageMigrant' then '🌊 Passage migrant'
        when 'PartialMigrant' then '↔️  Partial migrant' else migration_status end as label
    from ({CLASSED}) z, unnest(range(1, 13)) as months(m)""")
def _(t):
    classed = migration_facts(t.observation).select(
        "species", "migration_status", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return classed.select(
        "species", "month", "migration_status",
        migration.is_likely_present(F.col("migration_status"), F.col("month")).alias("present"),
        migration.migration_label(F.col("migration_status")).alias("label"))


MAP = """
    select o.species, obs_id, observed_on, individual_count, locality, lat, lon, scientific_name, common_name_en,
      common_name_da, common_name_fr, status
    from $observation o join $species s on s.species = o.species where true {0}"""


@query("map_extract", MAP.format(""))
def _(t):
    return queries.observations_for_map(t.species, t.observation)


@query("map_extract_filtered", MAP.format(
    "and contains(lower(family), 'family1') and contains(lower(order_name), 'order') and ("
    + name_condition(FULL, "fugl", "fugl", NAME_COLUMNS[:3]) + ")"))
def _(t):
    return queries.observations_for_map(t.species, t.observation, "Fugl", "Family1", "order")


SUMMARY = """
    with counts as (select o, count(distinct s) as c from $graph where p = '@TYPE@' group by o)
    select label, coalesce(c, 0) as n
    from (values ('orders', 'Order'), ('families', 'Family'), ('genera', 'Genus'), ('species', 'Species'),
      ('observations', 'Observation')) as l(label, cls) left join counts on o = '@ONT@'||cls"""


@query("taxonomy_summary", SUMMARY)
def _(t):
    types = t.graph.where(F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
    return queries.taxonomy_summary(types.select("s", F.col("o").alias("class")))


LABEL = """case status when 'CR' then 'Critically Endangered' when 'EN' then 'Endangered' when 'VU' then 'Vulnerable'
    when 'NT' then 'Near Threatened' when 'LC' then 'Least Concern' when 'DD' then 'Data Deficient'
    when 'NE' then 'Not Evaluated' when 'EX' then 'Extinct' when 'EW' then 'Extinct in the Wild' end"""


@query("status_histogram", f"""
    select status, {LABEL} as label, count(*) as n from $species
    where status in ('CR', 'EN', 'VU', 'NT', 'LC', 'DD', 'NE') group by status""")
def _(t):
    return extracts.status_histogram(t.species)


@query("status_labels", f"""
    select species, {LABEL} as label, {RANK.format('status')} as rank, coalesce(status in ('CR', 'EN', 'VU', 'NT'), false)
      as threatened
    from $species""")
def _(t):
    code = F.col("status")
    return t.species.select(
        "species", status.status_label(code).alias("label"), status.status_rank(code).alias("rank"),
        F.coalesce(status.is_threatened(code), F.lit(False)).alias("threatened"))


@query("distance_classes", f"""
    select obs_id, {KM} <= 2 as within_2, {KM} <= 25 as within_25, {KM} <= 100 as within_100 from $observation""")
def _(t):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), geo.DEFAULT_LAT, geo.DEFAULT_LON)
    return t.observation.select("obs_id", *[(km <= r).alias(f"within_{r}") for r in (2, 25, 100)])


@query("slugs", """
    select p_partkey, trim(regexp_replace(p_brand||'  '||p_name||'-'||p_type||'.', '[^A-Za-z0-9_-]', '_', 'g'), '_') as iri_slug,
      trim(regexp_replace(p_brand||'  '||p_name||'-'||p_type||'.', '[^A-Za-z0-9]', '_', 'g'), '_') as name_slug,
      list_extract(w, 1) || list_aggregate(list_transform(w[2:], lambda x: '_'||lower(x)), 'string_agg', '') as page_slug,
      w[1]||' '||w[2] as binomial
    from (select *, string_split_regex(trim(p_brand||'  '||p_name||' '||p_type), '\\s+') as w from {part}) x""")
def _(t):
    raw = F.concat(F.col("p_brand"), F.lit("  "), F.col("p_name"), F.lit("-"), F.col("p_type"), F.lit("."))
    spaced = F.concat(F.col("p_brand"), F.lit("  "), F.col("p_name"), F.lit(" "), F.col("p_type"))
    return t.given("part").select(
        "p_partkey", text.iri_slug(raw).alias("iri_slug"), text.name_slug(raw).alias("name_slug"),
        text.dbpedia_slug(spaced).alias("page_slug"), text.binomial(spaced).alias("binomial"))


@query("display_labels", """
    select species, coalesce(nullif(common_name_da, ''), nullif(common_name_en, ''), scientific_name) as label,
      regexp_extract(species, '[^/]*$') as short
    from $named_species""")
def _(t):
    return t.named_species.select(
        "species", text.first_non_empty(
            F.col("common_name_da"), F.col("common_name_en"), F.col("scientific_name")).alias("label"),
        text.last_segment(F.col("species")).alias("short"))


@query("months_of_text", """
    select o_orderkey, cast(month(try_cast(d as date)) as int) as month
    from (select o_orderkey, case when o_orderkey % 13 = 12 then '2024-02-30'
        else substr(cast(cast(o_orderdate as date) as varchar), 1, 10) end as d from {orders}) x""")
def _(t):
    return t.occurrence_record.select(
        F.col("seq").alias("o_orderkey"), migration.month_of_text(F.col("event_date")).alias("month"))
