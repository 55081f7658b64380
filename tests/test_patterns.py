"""Graph patterns joined after semi-join reduction, against plain joins."""

from __future__ import annotations

import itertools
import random

import pytest

from fieldlark.operators.triples import Pattern, join_tree, match_patterns
from tests.conftest import iri


def brute(facts, patterns):
    """All bindings by nested loops."""
    found = [{}]
    for s, p, o in patterns:
        grown = []
        for known, (fs, fp, fo, *_) in itertools.product(found, facts):
            if fp != p:
                continue
            now, fits = dict(known), True
            for part, value in ((s, fs), (o, fo)):
                if part.startswith("?"):
                    fits = fits and now.setdefault(part[1:], value) == value
                else:
                    fits = fits and part == value
            if fits:
                grown.append(now)
        found = grown
    return {tuple(sorted(b.items())) for b in found}


def facts(seed, n):
    draw = random.Random(seed)
    return sorted({iri(f"n{draw.randrange(9)}", draw.choice("pqr"), f"n{draw.randrange(9)}") for _ in range(n)})


CASES = {
    "one": [("?a", "p", "?b")], "fixed": [("?a", "p", "n3")], "both fixed and more": [("?a", "p", "n3"), ("?a", "q", "?b")],
    "path": [("?a", "p", "?b"), ("?b", "q", "?c"), ("?c", "r", "?d")], "star": [("?a", "p", "?b"), ("?a", "q", "?c"), ("?a", "r", "?d"), ("?a", "p", "n1")],
    "tree": [("?a", "p", "?b"), ("?b", "q", "?c"), ("?b", "r", "?d"), ("?d", "p", "?e"), ("?e", "q", "n2")],
    "same pair twice": [("?a", "p", "?b"), ("?a", "q", "?b"), ("?b", "r", "?c")], "loop": [("?a", "p", "?a"), ("?a", "q", "?b")],
    "circle": [("?a", "p", "?b"), ("?b", "q", "?c"), ("?c", "r", "?a")], "nothing": [("?a", "p", "?b"), ("?b", "none", "?c")],
}


@pytest.mark.parametrize("name", CASES)
def test_bindings(triples, name):
    rows = facts(7, 70)
    got = match_patterns(triples(rows), [Pattern(*p) for p in CASES[name]])
    result = [tuple(sorted(r.asDict().items())) for r in got.collect()]
    assert len(result) == len(set(result)) and set(result) == brute(rows, CASES[name])


def test_join_trees():
    def tree(patterns, sizes=None):
        return join_tree([Pattern(*p) for p in patterns], sizes or [1] * len(patterns))

    assert tree(CASES["one"]) == [] and len(tree(CASES["tree"])) == 4
    assert tree(CASES["circle"]) is None and tree([("?a", "p", "?b"), ("?c", "p", "?d")]) is None
    assert tree(CASES["path"], [5, 9, 1]) == [(0, 1), (1, 2)]  # the smallest pattern is the root


def shuffled_rows(spark, job):
    """Rows that the stages of a job write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_a_selective_pattern_shuffles_fewer_rows_than_joins_from_left_to_right(spark, triples, tmp_path):
    from fieldlark.operators.triples import match_all
    from fieldlark.sources.graph_files import read_graph, write_graph

    rows = [iri(f"s{i % 50}", "sees", f"o{i}") for i in range(4000)] + [iri(f"o{i}", "at", f"l{i % 900}") for i in range(4000)]
    rows += [iri(f"l{i}", "in", f"area{i % 30}") for i in range(900)] + [iri("s7", "kind", "rare")] + [iri(f"s{i}", "kind", "usual") for i in range(50) if i != 7]
    write_graph(triples(rows), str(tmp_path / "g"))
    graph = read_graph(spark, str(tmp_path / "g"))
    patterns = [Pattern("?s", "sees", "?o"), Pattern("?o", "at", "?l"), Pattern("?l", "in", "?a"), Pattern("?s", "kind", "rare")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plain = shuffled_rows(spark, lambda: match_all(*[p.bindings(graph) for p in patterns]).collect())
        less = shuffled_rows(spark, lambda: match_all(*match_reduced(graph, patterns)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert less < plain


def match_reduced(graph, patterns):
    from fieldlark.operators.triples import reduced

    counts = [4000, 4000, 900, 0]
    tables = [p.bindings(graph) for p in patterns]
    tree = join_tree(patterns, counts)
    tables = reduced(tables, tree)
    return [tables[i] for i in (tree[-1][1], *[ear for ear, _ in reversed(tree)])]


def test_a_graph_is_written_without_a_sort(spark, triples, tmp_path, monkeypatch):
    """A task holds no rows of the graph to sort them by predicate, unless it meets more predicates than it may open."""
    from fieldlark.sources import graph_files
    from tests.conftest import rows

    facts = [(f"s{i}", f"p{i % 5}", f"o{i}", "iri", "", "") for i in range(40)]
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    for name, files in (("side by side", 64), ("sorted behind two", 2)):
        monkeypatch.setattr(graph_files, "OPEN_FILES", files)
        graph_files.write_graph(triples(facts + facts), str(tmp_path / name))
        store = spark._jsparkSession.sharedState().statusStore()
        plan = store.execution(store.executionsCount() - 1).get().physicalPlanDescription()
        assert "Execute InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan
        assert rows(graph_files.read_graph(spark, str(tmp_path / name))) == sorted(facts, key=repr)
        assert spark.conf.get(setting) == before


def test_a_graph_read_by_predicate_is_written_without_a_shuffle(spark, triples, tmp_path):
    from fieldlark.plans.reasoning import run_reasoner
    from fieldlark.sources import graph_files
    from tests.conftest import rows

    facts = [(f"s{i}", f"p{i % 5}", f"o{i}", "iri", "", "") for i in range(40)]
    graph_files.write_graph(triples(facts), str(tmp_path / "a"), True)
    graph = graph_files.read_graph(spark, str(tmp_path / "a")).where("s <> 's3'")
    graph_files.write_graph(graph, str(tmp_path / "b"), True, by_predicate=True)
    kept = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = max((kept.apply(i) for i in range(kept.size())), key=lambda x: x.executionId()).physicalPlanDescription()
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Exchange" not in plan
    assert rows(graph_files.read_graph(spark, str(tmp_path / "b"))) == sorted(facts[:3] + facts[4:], key=repr)
    assert sorted(map(tuple, run_reasoner(graph, is_distinct=True, is_by_predicate=True).parts[0].collect())) == sorted(facts[:3] + facts[4:])
