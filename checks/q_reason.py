"""Inference rules on the graph."""

from pyspark.sql import functions as F

from checks.q_catalogue import CLASS
from checks.registry import query
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import closure, inference
from fieldlark.operators.triples import union_graphs
from fieldlark.plans.reasoning import run_reasoner

PAIRS = """pairs as (select child as node, parent as ancestor from $taxon_edge
      union select p.node, e.parent from pairs p join $taxon_edge e on e.child = p.ancestor)"""


@query("parent_closure", f"with recursive {PAIRS} select node, ancestor from pairs")
def _(t):
    return closure.transitive_pairs(t.taxon_edge)


@query("transitive_parents", f"""
    with recursive {PAIRS} select node as s, ancestor as o from pairs
    where not exists (select 1 from $taxon_edge e where e.child = node and e.parent = ancestor)""")
def _(t):
    return inference.transitive_parents(t.graph, V).select("s", "o")


@query("cyclic_closure", """
    with recursive edge as (select 'n'||n_nationkey as child, 'n'||((n_nationkey * 7 + n_regionkey) % 25) as parent from {nation}
        union select 'c'||c_custkey, 'n'||c_nationkey from {customer}),
      pairs as (select child as node, parent as ancestor from edge
        union select p.node, e.parent from pairs p join edge e on e.child = p.ancestor)
    select node, ancestor from pairs""")
def _(t):
    n, c = t.given("nation"), t.given("customer")
    edges = n.select(
        F.concat(F.lit("n"), "n_nationkey").alias("child"),
        F.concat(F.lit("n"), (F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("parent")).unionByName(
        c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent")))
    return closure.transitive_pairs(edges)


@query("subclass_types", """
    select distinct s, '@ONT@Taxon' as o from $graph where p = '@TYPE@'
      and o in ('@ONT@Order', '@ONT@Family', '@ONT@Genus', '@ONT@Species')""")
def _(t):
    return inference.subclass_types(t.graph).select("s", "o")


@query("domain_types", """
    select distinct g.s, d.o from $graph g join (select s, o from $graph where p = '@RDFS@domain') d on d.s = g.p
    where not exists (select 1 from $graph x where x.p = '@TYPE@' and x.s = g.s and x.o = d.o)""")
def _(t):
    return inference.domain_types(t.graph).select("s", "o")


@query("domain_types_without_names", """
    select distinct g.s, d.o from $graph g join (select s, o from $graph where p = '@RDFS@domain') d on d.s = g.p
    where g.p <> '@DWC@scientificName'
      and not exists (select 1 from $graph x where x.p = '@TYPE@' and x.s = g.s and x.o = d.o)""")
def _(t):
    return inference.domain_types(t.graph, exclude=[v.SCIENTIFIC_NAME]).select("s", "o")


BOTH = "(select a as src, b as dst from $same_as union select b, a from $same_as)"


@query("same_as_one_hop", f"""
    select distinct b.dst as s, g.p, g.o from $graph g join {BOTH} b on b.src = g.s where g.p <> '@SAME@'
      and not exists (select 1 from $graph x where x.s = b.dst and x.p = g.p and x.o = g.o)""")
def _(t):
    return inference.same_as_one_hop(t.graph).select("s", "p", "o")


COMPONENTS = f"""component as (select node, min(seen) as component from
      (with recursive reach as (select dst as node, dst as seen from {BOTH} x
        union select b.dst, r.seen from reach r join {BOTH} b on b.src = r.node) select * from reach) y group by node)"""


@query("same_as_components", f"with {COMPONENTS} select node, component from component")
def _(t):
    return inference.same_as_components(t.graph)


@query("same_as_merged", f"with {COMPONENTS} select node, component from component")
def _(t):
    """The links in four batches, each merged into the groups of those before."""
    links = t.graph.where(F.col("p") == v.SAME_AS)
    batch = F.pmod(F.xxhash64("s", "o"), F.lit(4))
    members = inference.same_as_components(links.where(batch == 0))
    for i in range(1, 4):
        members, _ = inference.same_as_merged(members, links.where(batch == i))
    return members


@query("component_properties", f"""
    with {COMPONENTS} select distinct component, p, o from $graph g join component c on c.node = g.s where p <> '@SAME@'""")
def _(t):
    return inference.component_properties(t.graph, inference.same_as_components(t.graph)).select("component", "p", "o")


MONTHS = "(select distinct species, month(observed_on) as m from $observation where observed_on is not null)"
MIGRATION = f"""
    with open as (select species, list(m order by m) as ms from {MONTHS} x
      where species not in (select species from $species where migration_status is not null) group by species)
    select species as s, '@ONT@migrationStatus' as p, {CLASS} as o from open
    union all select species, '@ONT@typicallyPresentInMonth', cast(unnest(ms) as varchar) from open"""


@query("migration_triples", MIGRATION)
def _(t):
    return inference.migration_rule(t.graph, V).select("s", "p", "o")


DIFF = """
    select class, coalesce(b.n, 0) as n_before, a.n as n_after, a.n - coalesce(b.n, 0) as inferred
    from (select o as class, count(distinct s) as n from (select s, o from $graph where p = '@TYPE@' union
        select s, '@ONT@Taxon' from $graph where p = '@TYPE@' and o in ('@ONT@Order', '@ONT@Family', '@ONT@Genus', '@ONT@Species'))
        x where starts_with(o, '@ONT@') group by o) a
    left join (select o, count(distinct s) as n from $graph where p = '@TYPE@' group by o) b on b.o = class"""


@query("class_counts_diff", DIFF)
def _(t):
    return inference.class_counts_diff(t.graph, union_graphs(t.graph, inference.subclass_types(t.graph)), V)


@query("ancestor_report", """
    select '@ONT@' as type, e.child as ancestor, e.parent as name from $taxon_edge e where false
    union all select 'Genus', '@GEN@'||c_nationkey||'_'||c_mktsegment, c_mktsegment from {customer} where c_custkey = 7
    union all select 'Family', '@FAM@'||c_nationkey, n_name from {customer} join {nation} on n_nationkey = c_nationkey where c_custkey = 7
    union all select 'Order', '@ORD@'||n_regionkey, r_name from {customer} join {nation} on n_nationkey = c_nationkey
      join {region} on r_regionkey = n_regionkey where c_custkey = 7""")
def _(t):
    closed = union_graphs(t.graph, inference.transitive_parents(t.graph, V))
    return inference.ancestor_report(closed, V.taxon("species/c7"), V)


# the five rules in sequence, in SQL
TYPED = """select s, o from $graph where p = '@TYPE@' union
      select s, '@ONT@Taxon' from $graph where p = '@TYPE@' and o in ('@ONT@Order', '@ONT@Family', '@ONT@Genus', '@ONT@Species')"""
REASONED = f"""
    with recursive {PAIRS}, r1 as (select s, p, o from $graph union select node, '@ONT@parentTaxon', ancestor from pairs),
      r2 as (select s, p, o from r1 union select s, '@TYPE@', '@ONT@Taxon' from r1 where p = '@TYPE@'
        and o in ('@ONT@Order', '@ONT@Family', '@ONT@Genus', '@ONT@Species')),
      r3 as (select s, p, o from r2 union select g.s, '@TYPE@', d.o from r2 g
        join (select s, o from $graph where p = '@RDFS@domain') d on d.s = g.p),
      r4 as (select s, p, o from r3 union select b.dst, g.p, g.o from r3 g join {BOTH} b on b.src = g.s where g.p <> '@SAME@'),
      r5 as (select s, p, o from r4 union ({MIGRATION}))"""


@query("reasoned_graph", REASONED + " select s, p, o from r5")
def _(t):
    return run_reasoner(t.graph, V, is_stored=True).triples.select("s", "p", "o")


@query("reasoner_report", REASONED + """
    , sizes as (select 0 as step, (select count(*) from $graph) as n union all select 1, (select count(*) from r1)
      union all select 2, (select count(*) from r2) union all select 3, (select count(*) from r3)
      union all select 4, (select count(*) from r4) union all select 5, (select count(*) from r5))
    select b.step, case b.step when 1 then 'transitive_parents' when 2 then 'subclass_types' when 3 then 'domain_types'
      when 4 then 'same_as' else 'migration' end as rule, b.n - a.n as n
    from sizes a join sizes b on b.step = a.step + 1""")
def _(t):
    return run_reasoner(t.graph, V, is_stored=True).added
