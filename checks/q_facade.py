"""The query catalogue through the stored graph: typed tables written by ``save`` and read by ``load``."""


from functools import reduce

from pyspark.sql import functions as F

from checks.q_catalogue import CLASSED, COMPAT, FULL, KM, RANK, SUMMARY, find_sql, name_condition
from checks.registry import query
from fieldlark import KnowledgeGraph
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import queries, trigrams
from fieldlark.operators.inference import migration_rule
from fieldlark.operators.triples import union_graphs
from fieldlark.session import scratch_path

OBSERVED = "(select '@OBS@'||obs_id as obs_id, species, observed_on, individual_count, lat, lon from $observation)"
NONE = "cast(null as varchar)"
NAMES = f"scientific_name, common_name_en, common_name_da, {NONE} as common_name_fr"


@query("kg_nearby_watch", f"""
    with latest as (
      select *, row_number() over (partition by species order by observed_on desc nulls last, obs_id) as rn
      from {OBSERVED} o where {KM} <= 25)
    select l.species, obs_id, observed_on, individual_count, {NONE} as locality, lat, lon, {NAMES}, status,
      {RANK.format('status')} as rank
    from latest l join $species s on s.species = l.species where rn = 1""")
def _(t):
    return t.saved("species", "observations").nearby_watch(radius_km=25.0)


@query("kg_find_by_name", f"""
    select species, {NAMES}, ebird_code, {NONE} as thumbnail, {NONE} as range_map, mass_grams, cast(null as double) as wingspan_mm,
      {NONE} as habitat, status, migration_status
    from $species where {name_condition(COMPAT, 'fugl 1', 'fugl 1', ['scientific_name', 'common_name_en', 'common_name_da'])}""")
def _(t):
    return t.saved("species", "habitats", "names").find_species_by_name("FUGL 1")


@query("kg_recent", f"""
    select o.*, {NONE} as locality, {NAMES} from (select * from {OBSERVED} x order by observed_on desc, obs_id limit 1000) o
    join $species s on s.species = o.species""")
def _(t):
    return t.saved("species", "observations").recent_observations(limit=1000)


@query("kg_species_by_family", f"""
    select species, scientific_name, common_name_en, common_name_da, ebird_code, {NONE} as thumbnail
    from $species where contains(lower(family), 'family1')""")
def _(t):
    return t.saved("species", "ranks").species_by_family("FAMILY1")


@query("kg_map", f"""
    select o.*, {NONE} as locality, {NAMES}, status from {OBSERVED} o join $species s on s.species = o.species
    where contains(lower(order_name), 'order2')""")
def _(t):
    return t.saved("species", "ranks", "observations").observations_for_map(order_filter="ORDER2", ordered=False)


@query("kg_present_in_month", f"""
    select s.species, {NAMES}, ebird_code, status, c.migration_status
    from $species s join ({CLASSED}) c on c.species = s.species where s.migration_status is null and list_contains(ms, 6)""")
def _(t):
    """The migration rule gives months and status to species that have none; then the graph is asked."""
    return KnowledgeGraph(union_graphs(t.graph, migration_rule(t.graph, V)), V).currently_present(6)


@query("kg_species_by_order", """
    select species, scientific_name, common_name_en, family from $species where contains(lower(order_name), 'order2')""")
def _(t):
    return t.saved("species", "ranks").species_by_order("Order2")


@query("kg_observed_species", f"""
    select species, {NAMES} from $species where species in (select species from $observation)""")
def _(t):
    return t.saved("species").list_observed_species()


@query("kg_recent_named", f"""
    select o.*, {NONE} as locality, {NAMES} from (select x.* from {OBSERVED} x where species in (select species from $species
      where {name_condition(FULL, 'fugl 1', 'fugl 1', ['scientific_name', 'common_name_en', 'common_name_da'])})
      order by observed_on desc, obs_id limit 40) o
    join $species s on s.species = o.species""")
def _(t):
    """The index finds the species, and months are read until forty of their observations are found."""
    return t.saved("species", "names", "observations").recent_observations("FUGL 1", fold="full", limit=40)


@query("kg_map_named", f"""
    select o.*, {NONE} as locality, {NAMES}, status from {OBSERVED} o join $species s on s.species = o.species
    where {name_condition(FULL, 'genus1 sp', 'genus1 sp', ['scientific_name', 'common_name_en', 'common_name_da'])}""")
def _(t):
    return t.saved("species", "names", "observations").observations_for_map("Genus1 SP", ordered=False)


@query("kg_summary", SUMMARY)
def _(t):
    return t.saved().taxonomy_summary()


@query("kg_network_edges", f"""
    with recursive up as (select child, parent from $taxon_edge where child in (
        select species from $species where contains(lower(order_name), 'order1') and species in (select species from $observation))
      union select e.child, e.parent from up join $taxon_edge e on e.child = up.parent)
    select child, parent from up""")
def _(t):
    return t.saved("species").taxonomy_network(order_filter="ORDER1")[1]


@query("kg_network_nodes", f"""
    with recursive kept as (select * from $species where contains(lower(order_name), 'order1') and species in (select species from $observation)),
      up as (select child, parent from $taxon_edge where child in (select species from kept)
        union select e.child, e.parent from up join $taxon_edge e on e.child = up.parent)
    select species as node, coalesce(common_name_da, common_name_en, scientific_name) as label, status, 'species' as "group" from kept
    union all select node, coalesce(g.o, regexp_extract(node, '[^/]*$')), null,
      case when starts_with(node, '@ORD@') then 'order' when starts_with(node, '@FAM@') then 'family' else 'genus' end
    from (select distinct parent as node from up) a
    left join (select s, o from $graph where p = '@DWC@scientificName') g on g.s = node""")
def _(t):
    return t.saved("species").taxonomy_network(order_filter="ORDER1")[0]


@query("kg_present_stored", f"""
    select s.species, {NAMES}, ebird_code, s.status, c.migration_status
    from $species s join ({CLASSED}) c on c.species = s.species where s.migration_status is null and list_contains(ms, 6)""")
def _(t):
    """The same from months and status that were stored with the graph."""
    path = scratch_path(t.spark, "present")
    KnowledgeGraph(union_graphs(t.graph, migration_rule(t.graph, V)), V).save(path, ["species", "months"])
    return KnowledgeGraph.load(t.spark, path, V, tables=["species", "months"]).currently_present(6)


@query("indexed_find_by_name", find_sql(COMPAT, "réê", "ree"))
def _(t):
    """Whole texts as names, searched through their trigrams."""
    species = t.named_species
    names = [species.select("species", F.lit(kind).alias("kind"), F.col(kind).alias("name")) for kind in queries.NAMES]
    path = scratch_path(t.spark, "names")
    trigrams.write_index(queries.name_table(reduce(lambda a, b: a.unionByName(b), names).where("name is not null")), path)
    found = trigrams.TrigramIndex.load(t.spark, path).find("Réê")
    return queries.find_species_by_name(species, t.habitat, "Réê", limit=queries.NAME_LIMIT, found=found)
