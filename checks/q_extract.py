"""Extracts for maps, networks, live views and the conversation log."""

from pyspark.sql import functions as F

from checks.q_catalogue import MAP
from checks.registry import query
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import extracts as ex, queries
from fieldlark.operators.inference import parent_edges
from fieldlark.sources import graph_files
from fieldlark.session import scratch_path

KEPT = "(select * from $species where contains(lower(order_name), 'order1') and species in (select species from $observation))"
EDGES = f"""reached as (select child, parent from $taxon_edge where child in (select species from {KEPT} k)
      union select e.child, e.parent from reached r join $taxon_edge e on e.child = r.parent)"""


def kept(t):
    return ex.network_species(t.species, t.observation, order_filter="ORDER1")


@query("taxonomy_edges", f"with recursive {EDGES} select child, parent from reached")
def _(t):
    return ex.taxonomy_edges(kept(t), parent_edges(t.graph, V))


@query("taxonomy_nodes", f"""
    with recursive {EDGES}
    select species as node, coalesce(common_name_da, common_name_en, scientific_name) as label, status, 'species' as "group"
    from {KEPT} k
    union all select node, coalesce(g.o, regexp_extract(node, '[^/]*$')), null,
      case when starts_with(node, '@ORD@') then 'order' when starts_with(node, '@FAM@') then 'family' else 'genus' end
    from (select distinct parent as node from reached) a
    left join (select s, o from $graph where p = '@DWC@scientificName') g on g.s = node""")
def _(t):
    chosen = kept(t)
    return ex.taxonomy_nodes(chosen, ex.taxonomy_edges(chosen, parent_edges(t.graph, V)), t.graph, V)


FEATURES = f"""select obs_id, scientific_name, lon, lat, coalesce(status, '?') as status,
      coalesce(common_name_da, common_name_en, scientific_name) as name,
      concat_ws('<br>', '<b>'||coalesce(common_name_da, common_name_en, scientific_name)||'</b>', '🇫🇷 '||common_name_fr,
        '<i>'||scientific_name||'</i>', 'IUCN: '||status, 'Date: '||observed_on, 'Count: '||individual_count,
        '📍 '||locality) as popup
    from ({MAP.format('')}) m"""


def features(t):
    return ex.map_features(queries.observations_for_map(t.species, t.observation, ordered=False))


@query("map_features", FEATURES)
def _(t):
    return features(t)


@query("map_totals", f"""
    select count(*) as n_observations, count(distinct scientific_name) as n_species from ({FEATURES}) f""")
def _(t):
    return ex.map_totals(features(t))


@query("geojson_lines", f"""
    select '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['||lon||','||lat||']}},"properties":{{"popup":"'||popup
      ||'","status":"'||status||'","name":"'||name||'"}}}}' as value
    from ({FEATURES}) f""")
def _(t):
    path = scratch_path(t.spark, "geojson")
    graph_files.write_geojson_lines(ex.geojson_lines(features(t)), path)
    return t.spark.read.text(path)


@query("live_flag", """
    select species, ebird_code, ebird_code in (select "speciesCode" from $sighting) as is_live from $species""")
def _(t):
    return ex.live_flag(t.species.select("species", "ebird_code"), t.sighting)


LIVE = """select "comName" as species, "sciName", "obsDt" as date, "locName" as location, lat, lng as lon,
      coalesce(cast("howMany" as varchar), 'X') as count from $sighting"""


@query("live_sightings", LIVE)
def _(t):
    return ex.live_sightings(t.sighting)


@query("recent_sightings", """
    select "speciesCode", count(*) as n from $sighting
    where cast(substr("obsDt", 1, 10) as date) between date '2024-01-31' - 14 and date '2024-01-31' group by all""")
def _(t):
    recent = ex.recent_sightings(t.sighting, F.lit("2024-01-31").cast("date"))
    return recent.groupBy("speciesCode").agg(F.count(F.lit(1)).alias("n"))


@query("result_cap", """
    select row_number() over (order by species)::int as position,
      '{"species":"'||species||'","family":"'||family||'"}' as "row", greatest((select count(*) from $species) - 25, 0) as left_out
    from $species qualify position <= 25""")
def _(t):
    return ex.result_cap(t.species.select("species", "family"), [F.col("species").asc()])


@query("result_text", """
    select '['||string_agg('{"species":"'||species||'"}', ','||chr(10) order by species)||']'||chr(10)||chr(10)||'… and '
      ||((select count(*) from $species) - 3)||' more results not shown.' as text
    from (select species from $species order by species limit 3) x""")
def _(t):
    return ex.result_text(ex.result_cap(t.species.select("species"), [F.col("species").asc()], 3))


ITEM = """'{"thumbnail":"'||coalesce(thumbnail, 'none')||'","commonNameFr":"'||coalesce(common_name_fr, '')
      ||'","scientificName":"'||scientific_name||'"}'"""


@query("thumbnails", """
    select family, name, url, seq, position from (
      select *, row_number() over (partition by family order by seq, position) as rk from (
        select family, thumbnail as url, species as seq, 0 as position, coalesce(common_name_fr, scientific_name) as name
        from $species where thumbnail is not null) u) v where rk <= 4""")
def _(t):
    def text(c):
        return F.coalesce(F.col(c), F.lit(""))
    item = F.concat(
        F.lit('{"thumbnail":"'), F.coalesce("thumbnail", F.lit("none")), F.lit('","commonNameFr":"'), text("common_name_fr"),
        F.lit('","scientificName":"'), text("scientific_name"), F.lit('"}'))
    listed = F.concat(F.lit("["), item, F.lit(","), item, F.lit("]"))
    results = t.species.select("family", "species", listed.alias("result"))
    broken = t.species.select("family", "species", item.alias("result"))
    return ex.thumbnails(results.unionByName(broken), ["family"], "species")


@query("history_trim", """
    select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn) as up,
        row_number() over (partition by conv_id order by turn desc) as down from {conversations}) x where up = 1 or down <= 3""")
def _(t):
    return ex.history_trim(t.given("conversations"), "conv_id", "turn", keep=3)


@query("session_expiry", """
    select user_id, max(ts) as last_seen from {events} group by user_id
    having max(ts) < timestamp '2024-01-30 21:00:00' - interval 7200 second""")
def _(t):
    return ex.expired_sessions(t.given("events"), "user_id", "ts", F.lit("2024-01-30 21:00:00").cast("timestamp_ntz"))


SESSIONS = """select user_id, min(ts) as started, max(ts) as ended, count(*) as n from (
      select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (
        select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 7200 second then 0 else 1 end
          as fresh from {events}) x) y group by user_id, session"""


@query("sessions", SESSIONS)
def _(t):
    return ex.sessions(t.given("events"), "user_id", "ts")
