"""Relational primitives over the triple table."""

from pyspark.sql import functions as F

from checks.registry import query
from fieldlark.model import vocab as v
from fieldlark.model.ontology import ontology_triples
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import triples as T
from fieldlark.plans import graph as plans
from fieldlark.session import scratch_path
from fieldlark.sources import graph_files


def where(p: str, o: str | None = None) -> str:
    return f"select s, o from $graph where p = '{p}'" + (f" and o = '{o}'" if o else "")


@query("triple_scan", where("@DWC@family"))
def _(t):
    return T.scan(t.graph, p=v.FAMILY).select("s", "o")


@query("triple_path", f"""
    select h.s as species, h.o as obs, cast(la.o as double) as lat
    from ({where('@ONT@hasObservation')}) h join ({where('@ONT@observedAt')}) a on a.s = h.o
      join ({where('@ONT@latitude')}) la on la.s = a.o""")
def _(t):
    path = T.match_all(
        T.pattern(t.graph, "species", V.has_observation, "obs"),
        T.pattern(t.graph, "obs", V.term("observedAt"), "loc"),
        T.pattern(t.graph, "loc", V.term("latitude"), "lat"))
    return path.select("species", "obs", F.col("lat").cast("double").alias("lat"))


@query("triple_path_reduced", f"""
    select h.s as species, h.o as obs, la.o as lat
    from ({where('@ONT@hasObservation')}) h join ({where('@ONT@observedAt')}) a on a.s = h.o
      join ({where('@ONT@latitude')}) la on la.s = a.o""")
def _(t):
    path = T.match_patterns(t.graph, [
        T.Pattern("?species", V.has_observation, "?obs"), T.Pattern("?obs", V.term("observedAt"), "?loc"),
        T.Pattern("?loc", V.term("latitude"), "?lat")])
    return path.select("species", "obs", "lat")


@query("triple_six_patterns", f"""
    select distinct f.s as species, h.o as obs, d.o as date, a.o as loc, la.o as lat
    from ({where('@DWC@family', 'Family7')}) f join ({where('@TYPE@', '@ONT@Species')}) x on x.s = f.s
      join ({where('@ONT@hasObservation')}) h on h.s = f.s join ({where('@ONT@observedOn')}) d on d.s = h.o
      join ({where('@ONT@observedAt')}) a on a.s = h.o join ({where('@ONT@latitude')}) la on la.s = a.o""")
def _(t):
    return T.match_patterns(t.graph, [
        T.Pattern("?species", V.has_observation, "?obs"), T.Pattern("?obs", V.term("observedOn"), "?date"),
        T.Pattern("?obs", V.term("observedAt"), "?loc"), T.Pattern("?loc", V.term("latitude"), "?lat"),
        T.Pattern("?species", v.FAMILY, "Family7"), T.Pattern("?species", v.TYPE, V.term("Species"))])


@query("triple_optional", f"""
    select x.s as species, st.o as status, h.o as obs, d.o as date
    from ({where('@TYPE@', '@ONT@Species')}) x
      left join ({where('@ONT@conservationStatus')}) st on st.s = x.s
      left join ({where('@ONT@hasObservation')}) h on h.s = x.s left join ({where('@ONT@observedOn')}) d on d.s = h.o""")
def _(t):
    dated = T.optional(
        T.pattern(t.graph, "species", V.has_observation, "obs"),
        T.pattern(t.graph, "obs", V.term("observedOn"), "date"))
    rows = T.optional(
        T.instances(t.graph, V.term("Species"), "species"),
        T.pattern(t.graph, "species", V.term("conservationStatus"), "status"))
    return T.optional(rows, dated)


@query("triple_values", f"""
    select s as species, o as name from ({where('@DWC@scientificName')}) x
    where s in (select '@SP@c'||s_suppkey from {{supplier}})""")
def _(t):
    inline = t.given("supplier").select(F.concat(F.lit(V.canonical_species), F.lit("c"), "s_suppkey").alias("species"))
    return T.values(T.pattern(t.graph, "species", v.SCIENTIFIC_NAME, "name"), inline)


@query("triple_not_exists", f"""
    select s as species from ({where('@TYPE@', '@ONT@Species')}) x
    where s not in (select s from $graph where p = '@ONT@conservationStatus')""")
def _(t):
    return T.not_exists(
        T.instances(t.graph, V.term("Species"), "species"),
        T.pattern(t.graph, "species", V.term("conservationStatus"), "status"))


@query("triple_exists", f"""
    select s as species from ({where('@TYPE@', '@ONT@Species')}) x
    where s in (select s from $graph where p = '@ONT@hasObservation')""")
def _(t):
    return T.exists(
        T.instances(t.graph, V.term("Species"), "species"),
        T.pattern(t.graph, "species", V.has_observation, "obs"))


@query("triple_distinct", "select distinct s, p, o, o_kind, o_lang, o_datatype from $graph")
def _(t):
    return T.union_graphs(t.graph, t.graph, T.scan(t.graph, p=v.TYPE))


@query("triple_top", f"select s, o from ({where('@ONT@observedOn')}) x order by o desc, s limit 100")
def _(t):
    return T.top(T.scan(t.graph, p=V.term("observedOn")).select("s", "o"), 100, F.desc("o"), F.asc("s"))


@query("triple_count_distinct", "select count(distinct s) as n from $graph")
def _(t):
    return T.count_distinct(t.graph, "s")


@query("triple_group_count", f"select o as status, count(*) as n from ({where('@ONT@conservationStatus')}) x group by o")
def _(t):
    return T.count_by(T.pattern(t.graph, "s", V.term("conservationStatus"), "status"), "status")


@query("triple_canonical", f"""
    select distinct node from (select s as node from ({where('@SAME@')}) x union all select o from ({where('@SAME@')}) y) z
    where starts_with(node, '@SP@')""")
def _(t):
    pairs = T.scan(t.graph, p=v.SAME_AS)
    nodes = pairs.select(F.col("s").alias("node")).unionByName(pairs.select(F.col("o").alias("node")))
    return nodes.where(T.is_canonical(F.col("node"), V)).distinct()


@query("triple_numeric_range", f"""
    select s, cast(o as double) as value from ({where('@ONT@latitude')}) x where cast(o as double) between 55.5 and 56.25""")
def _(t):
    rows = T.scan(t.graph, p=V.term("latitude")).where(T.numeric_between(F.col("o"), 55.5, 56.25))
    return rows.select("s", F.col("o").cast("double").alias("value"))


@query("triple_constant_object", where("@ONT@individualCount", "7"))
def _(t):
    return T.scan(t.graph, p=V.term("individualCount"), o="7").select("s", "o")


def not_evaluated(t):
    """A status for every species that has a migration status; some have it already."""
    return T.scan(t.graph, p=V.term("migrationStatus")).withColumns(
        {"p": F.lit(V.term("conservationStatus")), "o": F.lit("NE")})


NEW = f"select s, '@ONT@conservationStatus' as p, 'NE' as o from ({where('@ONT@migrationStatus')}) m"


@query("triple_union", f"select s, p, o from $graph union {NEW}")
def _(t):
    return T.union_graphs(t.graph, not_evaluated(t)).select("s", "p", "o")


@query("triple_without", "select s, p, o from $graph where p <> '@ONT@conservationStatus'")
def _(t):
    return T.without(t.graph, p=V.term("conservationStatus")).select("s", "p", "o")


@query("triple_replace_values", f"""
    select s, p, o from $graph g where not exists (select 1 from ({NEW}) n where n.s = g.s and n.p = g.p) union {NEW}""")
def _(t):
    return T.replace_values(t.graph, not_evaluated(t)).select("s", "p", "o")


@query("triple_missing", f"""
    select s from ({where('@ONT@parentTaxon')}) x where s not in (select s from ({where('@TYPE@', '@ONT@Species')}) y)""")
def _(t):
    new = T.scan(t.graph, p=V.parent_taxon).withColumns({"p": F.lit(v.TYPE), "o": F.lit(V.term("Species"))})
    return T.missing_from(t.graph, new).select("s")


@query("triple_first_value", f"select s, min(o) as link from ({where('@SAME@')}) x group by s")
def _(t):
    return T.first_value(t.graph, v.SAME_AS, "link")


@query("entity_pivot", """
    select s, min(case when p = '@DWC@scientificName' then o end) as name, min(case when p = '@SAME@' then o end) as link,
      min(case when p = '@ONT@conservationStatus' then o end) as status
    from $graph where s in (select s from $graph where p = '@TYPE@' and o = '@ONT@Species') group by s""")
def _(t):
    return T.entity_table(t.graph, {
        "name": v.SCIENTIFIC_NAME, "link": v.SAME_AS, "status": V.term("conservationStatus")}, V.term("Species"))


@query("typed_species", """
    select species, scientific_name, common_name_en, common_name_da, cast(null as varchar) as common_name_fr, ebird_code,
      family, order_name, cast(null as varchar) as thumbnail, cast(null as varchar) as range_map, mass_grams,
      cast(null as double) as wingspan_mm, status, migration_status
    from $species""")
def _(t):
    return plans.species_table(t.graph, V)


@query("typed_observations", """
    select '@OBS@'||obs_id as obs_id, species, observed_on, individual_count,
      '@LOC@'||replace(printf('%.4f_%.4f', lat, lon), '.', 'p') as loc_id, lat, lon, cast(null as varchar) as locality
    from $observation""")
def _(t):
    return plans.observation_table(t.graph, V)


@query("merged_records", """
    select o.species, o.obs_id, coalesce(cast(o.locality as varchar), s.family) as note, s.scientific_name
    from (select species, obs_id, case when obs_id % 2 = 0 then locality end as locality from $observation) o
    left join $species s on s.species = o.species""")
def _(t):
    seen = t.observation.select("species", "obs_id", F.when(F.col("obs_id") % 2 == 0, F.col("locality")).alias("note"))
    return T.merge_records(t.species.select("species", "scientific_name", F.col("family").alias("note")), seen, "species")


@query("ntriples_round_trip", "select distinct s, p, o, o_kind, o_lang, o_datatype from $graph")
def _(t):
    path = scratch_path(t.spark, "nt")
    graph_files.write_ntriples(t.graph, path, distinct=True)  # its rows differ, see derived_graph
    return graph_files.read_ntriples(t.spark, path)


@query("ntriples_long_texts", "select distinct '@SP@d'||doc_id as s, '@ONT@text' as p, text as o from {documents} where text is not null")
def _(t):
    path = scratch_path(t.spark, "nt")
    texts = T.to_triples(t.given("documents"), [
        T.Fact(F.concat(F.lit(V.taxon("species/d")), "doc_id"), V.term("text"), F.col("text"))])
    graph_files.write_ntriples(texts, path)
    return graph_files.read_ntriples(t.spark, path).select("s", "p", "o")


@query("ntriples_escapes", """
    select '@SP@é'||event_id as s, '@ONT@🐦' as p, '🐦 '||event_type||' 🐦 \\U0001F426 "it''s" '||user_id as o from {events}""")
def _(t):
    """Escaped characters within and beyond the basic plane, in literals and in names of nodes."""
    path = scratch_path(t.spark, "nt")
    line = F.concat(
        F.lit(f"<{V.taxon('species/')}\\u00e9"), "event_id", F.lit(f"> <{V.term('')}\\U0001F426> \"\\U0001F426 "), "event_type",
        F.lit(" \\uD83D\\uDC26 \\\\U0001F426 \\\"it\\'s\\\" "), F.col("user_id").cast("string"), F.lit('" .'))
    t.given("events").select(line.alias("value")).write.text(path)
    return graph_files.read_ntriples(t.spark, path).select("s", "p", "o")


@query("ntriples_iris", """
    select '@SP@'||chr(cast(event_id % 127 + 1 as int))||event_id as s, '@ONT@'||chr(cast(event_id % 32 + 1 as int)) as p,
      case when event_id % 2 = 0 then '_:'||chr(cast(event_id % 127 + 1 as int))||user_id else 'x'||chr(cast(event_id % 127 + 1 as int)) end as o,
      case when event_id % 3 > 0 then 'iri' else 'literal' end as o_kind,
      case when event_id % 3 = 0 then '@XSD@'||chr(cast(event_id % 127 + 1 as int)) else '' end as o_datatype
    from {events}""")
def _(t):
    """Every ASCII sign in subjects, predicates, objects and data types, written and strictly read back."""
    sign = F.char((F.col("event_id") % 127 + 1).cast("int"))
    literal = F.col("event_id") % 3 == 0
    made = t.given("events").select(
        F.concat(F.lit(V.taxon("species/")), sign, "event_id").alias("s"),
        F.concat(F.lit(V.term("")), F.char((F.col("event_id") % 32 + 1).cast("int"))).alias("p"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("_:"), sign, "user_id")).otherwise(F.concat(F.lit("x"), sign)).alias("o"),
        F.when(literal, "literal").otherwise("iri").alias("o_kind"), F.lit("").alias("o_lang"),
        F.when(literal, F.concat(F.lit(v.XSD), sign)).otherwise("").alias("o_datatype"))
    path = scratch_path(t.spark, "nt")
    graph_files.write_ntriples(made, path)
    return graph_files.read_ntriples(t.spark, path).select("s", "p", "o", "o_kind", "o_datatype")


@query("ntriples_report", """
    select count(*) filter (event_type <> 'error') as n_triples, count(*) filter (event_type = 'error') as n_bad from {events}""")
def _(t):
    path = scratch_path(t.spark, "nt")
    line = F.concat(F.lit("<s> <p> "), F.when(F.col("event_type") == "error", F.lit('"open')).otherwise(F.lit("<o>")), F.lit(" ."))
    t.given("events").select(line.alias("value")).write.text(path)
    return graph_files.ntriples_report(t.spark, path)


@query("parquet_round_trip", where("@ONT@commonNameDa"))
def _(t):
    path = scratch_path(t.spark, "graph")
    graph_files.write_graph(t.graph, path)
    return T.scan(graph_files.read_graph(t.spark, path), p=V.term("commonNameDa")).select("s", "o")


@query("ontology_triples", """
    with declared as (select distinct s from $graph where p = '@TYPE@' and starts_with(o, '@OWL@'))
    select term, count(*) as n from (select p as term from $graph union all select o from $graph where p = '@TYPE@') u
    where term in (select s from declared) group by term""")
def _(t):
    """How many triples use each term that the ontology declares."""
    declared = ontology_triples(t.spark, V).where(
        (F.col("p") == v.TYPE) & F.col("o").startswith(v.OWL)).select(F.col("s").alias("term"))
    used = t.graph.select(F.col("p").alias("term")).unionByName(T.pattern(t.graph, "_", v.TYPE, "term").select("term"))
    return T.count_by(T.exists(used, declared), "term")
