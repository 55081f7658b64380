"""Nested intervals against plain walks, list ranking and running totals against sums."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import intervals
from fieldlark.operators.closure import transitive_pairs
from fieldlark.operators.ordering import list_ranks, ranked, running_totals

EDGE = "child string, parent string"


def walk(edges):
    """(node, parent, root, depth, lo, hi) of the forest, by recursion."""
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(p, None)
            others = [x for x in (up.get(c), p) if x is not None and x != c]
            up[c] = min(others, default=c)
    down = defaultdict(list)
    for c, p in up.items():
        down[p].append(c)
    out, n = {}, 0
    stack = [(r, r, 0, False) for r in sorted(down[None], reverse=True)]
    while stack:
        node, root, depth, left = stack.pop()
        if left:
            out[node] = (*out[node], n - 1)
            continue
        out[node], n = (up[node], root, depth, n), n + 1
        stack.append((node, root, depth, True))
        stack += [(c, root, depth + 1, False) for c in sorted(down[node], reverse=True)]
    return sorted((k, *v) for k, v in out.items())


def labels(spark, edges):
    forest = intervals.interval_labels(spark.createDataFrame(edges, EDGE))
    return sorted(tuple(r) for r in forest.labels.select(intervals.LABELS).collect()), sorted(tuple(r) for r in forest.in_cycles.collect())


def random_forest(seed, n):
    draw = random.Random(seed)
    return [(f"n{i}", f"n{draw.randrange(max(0, i - 20), i)}") for i in range(1, n) if draw.random() < 0.95]


@pytest.mark.parametrize("edges", [
    [], [(None, "a"), ("b", None), (None, None)], [("a", "b")], [("a", "b"), ("a", "b")],
    [("s1", "g"), ("s2", "g"), ("g", "f"), ("s3", "h"), ("h", "f"), ("x", "y")],
    [("a", "p"), ("a", "q"), ("q", "r")],  # the lesser parent counts
    [(f"c{i}", "hub") for i in range(300)] + [("hub", "top")],
    random_forest(1, 400),
], ids=["empty", "nulls", "one", "repeated", "forest", "two parents", "hub", "random"])
def test_labels(spark, edges):
    assert labels(spark, edges) == (walk(edges), [])


def test_cycles_are_reported_and_the_rest_is_labelled(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("under", "a"), ("deeper", "under"), ("self", "self"), ("s", "g"), ("g", "f")]
    got, cycles = labels(spark, edges)
    assert got == walk([("s", "g"), ("g", "f")])
    assert cycles == sorted([("a", "b", True), ("b", "c", True), ("c", "a", True), ("under", "a", False),
                             ("deeper", "under", False), ("self", "self", True)])


def test_other_parents(spark):
    edges = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "a"), ("b", "p"), ("z", "z"), (None, "p")], EDGE)
    assert sorted(tuple(r) for r in intervals.other_parents(edges).collect()) == [("a", "a"), ("a", "q")]


def test_range_filters_equal_the_closure(spark):
    edges = spark.createDataFrame(random_forest(2, 120), EDGE)
    pairs = {tuple(r) for r in transitive_pairs(edges).collect()}
    forest = intervals.interval_labels(edges).labels.cache()
    for x in ("n0", "n3", "n60", "n119"):
        bounds = intervals.interval_of(forest, x)
        assert {r.node for r in intervals.below(forest, bounds).collect()} == {n for n, a in pairs if a == x}
        assert {r.node for r in intervals.above(forest, bounds).collect()} == {a for n, a in pairs if n == x}
    assert intervals.interval_of(forest, "none") is None
    assert intervals.below(forest, None).isEmpty() and intervals.above(forest, None).isEmpty()
    forest.unpersist()


def test_filters_reach_the_scan(spark, tmp_path):
    intervals.interval_labels(spark.createDataFrame([("s", "g"), ("g", "f")], EDGE)).labels.write.parquet(str(tmp_path / "taxa"))
    taxa = spark.read.parquet(str(tmp_path / "taxa"))
    for rows in (intervals.below, intervals.above):
        plan = rows(taxa, intervals.Interval(1, 2))._jdf.queryExecution().executedPlan().toString()
        pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
        assert "(lo," in pushed.split("PushedFilters")[1] and "Than" in pushed


def test_closed_links_give_the_same_forest(spark):
    edges = spark.createDataFrame(random_forest(3, 60), EDGE)
    closed = transitive_pairs(edges).withColumnsRenamed({"node": "child", "ancestor": "parent"})
    assert sorted(intervals.direct_edges(closed).collect()) == sorted(edges.collect())


def test_counts_below(spark):
    edges = random_forest(4, 200)
    df = spark.createDataFrame(edges, EDGE)
    marked = [f"n{i}" for i in range(0, 220, 3)]
    forest = intervals.interval_labels(df).labels
    got = {r.node: r.n_below for r in intervals.counts_below(
        forest, spark.createDataFrame([(x,) for x in marked * 2], "node string")).collect()}
    at = {r[0]: r for r in walk(edges)}
    assert got == {n: sum(1 for m in set(marked) if m in at and at[n][4] <= at[m][4] <= at[n][5]) for n in at}


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    n, writes = 100_000, []
    from fieldlark.operators import intervals as module, ordering
    from fieldlark.session import cut_lineage

    def counted(df, label):
        writes.append(label)
        return cut_lineage(df, label)

    for place in (module, ordering):
        monkeypatch.setattr(place, "cut_lineage", counted)
    chain = spark.range(1, n).select(
        F.format_string("n%06d", "id").alias("child"), F.format_string("n%06d", F.col("id") - 1).alias("parent"))
    got = intervals.interval_labels(chain).labels
    wrong = got.where("node <> format_string('n%06d', depth) or lo <> depth or hi <> 99999 or root <> 'n000000'")
    assert wrong.isEmpty() and got.count() == n
    assert len(writes) < 70


def test_list_ranks(spark):
    draw = random.Random(6)
    ids = draw.sample(range(10_000), 700)
    lists = [ids[:1], ids[1:3], ids[3:300], ids[300:]]
    rows, want = [], {}
    for one in lists:
        total = 0
        for x, nxt in reversed(list(zip(one, [*one[1:], None]))):
            weight = draw.randrange(5)
            total += weight
            rows.append((x, nxt, weight))
            want[x] = total
    got = list_ranks(spark.createDataFrame(rows, "id long, next long, weight long"), "test")
    assert {r.id: r["rank"] for r in got.collect()} == want


def test_running_totals_over_several_buckets(spark):
    values = spark.range(0, 10_000).select(F.col("id").alias("at"), (F.col("id") % 7).alias("value"))
    got = {r["at"]: r.total for r in running_totals(values, "test").collect()}
    total, want = 0, {}
    for i in range(10_000):
        total += i % 7
        want[i] = total
    assert got == want


def test_ranked_numbers_a_hot_group_over_many_ranges(spark):
    keys = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    rows = [("hot", i % 50) for i in range(300)] + [("b", 2), ("b", None), ("a", 1)]
    try:
        for k, value in keys.items():
            spark.conf.set(k, value)
        got = ranked(spark.createDataFrame(rows, "g string, x int"), F.col("g"), [F.col("x")], "test").collect()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    for g in ("hot", "a", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r["__pos"])
        assert [r["__pos"] for r in own] == list(range(len(own))) and {r["__size"] for r in own} == {len(own)}
        values = [(r.x is not None, r.x or 0) for r in own]
        assert values == sorted(values)
