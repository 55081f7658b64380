"""The taxonomy as nested intervals."""

from pyspark.sql import functions as F

from checks.q_reason import PAIRS
from checks.registry import query
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import intervals

# a walk in the order of the paths is the walk in the order of siblings
WALK = """walk as (
      select distinct parent as node, cast(null as varchar) as parent, [parent] as path from $taxon_edge
        where parent not in (select child from $taxon_edge)
      union all select e.child, e.parent, list_append(w.path, e.child) from walk w join $taxon_edge e on e.parent = w.node),
    numbered as (select *, row_number() over (order by path) - 1 as lo from walk),
    sized as (select a.node, count(*) as n from numbered a join numbered b on b.path[1:len(a.path)] = a.path group by a.node)"""


@query("taxon_intervals", f"""
    with recursive {WALK}
    select x.node, parent, path[1] as root, cast(len(path) - 1 as bigint) as depth, lo, lo + n - 1 as hi
    from numbered x join sized on sized.node = x.node""")
def _(t):
    return intervals.interval_labels(t.taxon_edge).labels


@query("below_family", f"""
    with recursive {PAIRS} select node from pairs where ancestor = '@FAM@7' and node <> ancestor""")
def _(t):
    return t.saved("taxa").taxa_below(V.taxon("family/7")).select("node")


@query("ancestors_of_species", f"""
    with recursive {PAIRS} select ancestor from pairs where node = '@SP@c7'""")
def _(t):
    return t.saved("taxa").ancestors(V.taxon("species/c7")).select(F.col("node").alias("ancestor"))


@query("observed_below", f"""
    with recursive {PAIRS}, seen as (select distinct species as node from $observation),
      every as (select node, node as ancestor from pairs union select ancestor, ancestor from pairs union select node, ancestor from pairs)
    select ancestor as node, count(distinct seen.node) as n_below from every left join seen on seen.node = every.node group by ancestor""")
def _(t):
    return t.saved("taxa").observed_below().select("node", "n_below")


@query("cyclic_taxa", """
    with recursive edge as (select 'c'||c_custkey as child, 'c'||((c_custkey * 7 + 3) % 40) as parent from {customer}
        union select 'x'||o_orderkey, case when o_orderkey % 3 = 0 then 'r' else 'c'||(o_orderkey % 60) end from {orders}),
      pairs as (select child as node, parent as ancestor from edge
        union select p.node, e.parent from pairs p join edge e on e.child = p.ancestor),
      turning as (select distinct node from pairs where node = ancestor)
    select e.child as node, e.parent, e.child in (select node from turning) as on_cycle from edge e
    where e.child in (select node from turning) or e.child in (select node from pairs where ancestor in (select node from turning))""")
def _(t):
    c, o = t.given("customer"), t.given("orders")
    low = F.concat(F.lit("c"), F.col("o_orderkey") % 60)
    edges = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("c"), (F.col("c_custkey") * 7 + 3) % 40).alias("parent")
    ).unionByName(o.select(
        F.concat(F.lit("x"), "o_orderkey").alias("child"),
        F.when(F.col("o_orderkey") % 3 == 0, "r").otherwise(low).alias("parent")))
    return intervals.interval_labels(edges).in_cycles
