"""Data-quality checks on the graph and on folded traits."""

from pyspark.sql import functions as F

from checks.registry import query
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import quality as q
from fieldlark.operators.triples import count_by, match_all, pattern, without


def renamed(t):
    """The graph with one class and one predicate that nobody declared."""
    p, o = F.col("p"), F.col("o")
    return t.graph.withColumns({
        "o": F.when((p == v.TYPE) & (o == V.term("Genus")), V.term("Clade")).otherwise(o),
        "p": F.when(p == V.term("commonNameDa"), V.term("nick")).otherwise(p)})


@query("undeclared_classes", """
    select '@ONT@Clade' as class, count(*) as n from $graph where p = '@TYPE@' and o = '@ONT@Genus'""")
def _(t):
    return q.undeclared_classes(renamed(t), V)


@query("undeclared_properties", "select '@ONT@nick' as prop, count(*) as n from $graph where p = '@ONT@commonNameDa'")
def _(t):
    return q.undeclared_properties(renamed(t), V)


@query("missing_superclasses", """
    select l.s as sub, l.o as sup, count(*) as n from $graph l join $graph g on g.p = '@TYPE@' and g.o = l.s
    where l.p = '@RDFS@subClassOf' and l.s in ('@ONT@Order', '@ONT@Genus') group by all""")
def _(t):
    """Links between classes that the graph lacks, with the instances concerned."""
    held = without(without(t.graph, s=V.term("Order"), p=v.SUBCLASS_OF), s=V.term("Genus"), p=v.SUBCLASS_OF)
    lacking = q.missing_superclasses(held, V)
    return count_by(match_all(pattern(held, "_", v.TYPE, "sub"), lacking), "sub", "sup")


@query("minimum_counts", """
    select cls as measure, n, lim as "limit", n > lim as ok from (values ('Species', cast(10000 as bigint)), ('Observation', 0))
      as l(cls, lim) join (select o, count(distinct s) as n from $graph where p = '@TYPE@' group by o) c on o = '@ONT@'||cls""")
def _(t):
    return q.minimum_counts(t.graph, vocab=V)


@query("coverage_ratio", """
    with sp as (select count(*) as n, count(scientific_name) as a, count(common_name_da) as b, count(status) as c from $species)
    select 'scientific_name' as measure, a as n_present, n as n_all, a > n * 0.99 as ok from sp
    union all select 'common_name_da', b, n, b > n * 0.95 from sp union all select 'status', c, n, c > n * 0.5 from sp""")
def _(t):
    return q.share_present(t.species, scientific_name=0.99, common_name_da=0.95, status=0.5)


@query("graph_shares", """
    with sp as (select count(*) as n, count(common_name_en) as en, count(scientific_name) as sci from $species),
      ob as (select count(*) as n, count(observed_on) as d, count(lat) as l from $observation)
    select 'scientific_name' as measure, sci as n_present, n as n_all, sci > n * 0.99 as ok from sp
    union all select 'common_name_en', en, n, en > n * 0.95 from sp union all select 'observed_on', d, n, d > n * 0.95 from ob
    union all select 'location', l, n, l > n * 0.95 from ob""")
def _(t):
    return q.species_shares(t.graph, V).unionByName(q.observation_shares(t.graph, V))


@query("blank_names", "select species, '  ' as name from $species where family = 'Family3'")
def _(t):
    family3 = t.species.where("family = 'Family3'").select(F.col("species").alias("s"), F.lit(True).alias("blank"))
    graph = t.graph.join(family3, "s", "left").withColumn(
        "o", F.when(F.col("blank") & (F.col("p") == v.SCIENTIFIC_NAME), "  ").otherwise(F.col("o"))).drop("blank")
    return q.blank_names(graph, V)


@query("link_counts", """
    with r as (select cast(0 as bigint) as zero, count(*) filter (p = '@ONT@massGrams') as mass,
        count(*) filter (p = '@SAME@' and contains(o, 'ebird.org')) as links from $graph)
    select 'wikidata_links' as measure, links as n, cast(1000 as bigint) as "limit", links > 1000 as ok from r
    union all select 'wingspan', mass, 100, mass > 100 from r union all select 'range', zero, 1000, false from r
    union all select 'diel', zero, 100, false from r""")
def _(t):
    graph = t.graph.withColumns({
        "p": F.when(F.col("p") == V.term("massGrams"), V.term("wingspanMm")).otherwise(F.col("p")),
        "o": F.replace("o", F.lit("ebird.org"), F.lit("wikidata.org"))})
    return q.link_counts(graph, vocab=V)


@query("range_violations", """
    select species, 'mass_grams' as measure, mass_grams as value from $species where not mass_grams between 0.5 and 200000
    union all select species, 'wingspan_mm', wingspan_mm from $species where not wingspan_mm between 5 and 4000""")
def _(t):
    return q.range_violations(t.species, "species")


@query("triple_total", "select count(*) as n, count(*) > 200000 as ok from $graph")
def _(t):
    return q.triple_total(t.graph)


@query("dangling_references", """
    select species as s, '@ONT@hasObservation' as p, '@OBS@'||obs_id as o from $observation where individual_count = 7""")
def _(t):
    gone = t.observation.where("individual_count = 7").select(
        F.concat(F.lit(V.observation()), "obs_id").alias("s"))
    return q.dangling_references(t.graph.join(gone, "s", "left_anti"), V)
