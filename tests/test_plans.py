"""What the plans must look like."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import tables
from checks.registry import ORACLES, QUERIES
from checks.tables import Tables
from fieldlark import KnowledgeGraph, session
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import inference, occurrences, queries
from fieldlark.operators.triples import scan
from fieldlark.plans.graph import observation_table
from fieldlark.sources import graph_files
from tests.conftest import rows, two_species

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Species and observations as parquet, as a job would read them."""
    t = Tables(spark, FOLDER)
    root = tmp_path_factory.mktemp("stored")
    for name in ("species", "observation"):
        getattr(t, name).write.parquet(str(root / name))
    graph_files.write_graph(t.derived_graph(), str(root / "graph"))
    return root


def test_nearby_box_and_prefix_reach_the_scan(spark, stored):
    text = plan(queries.nearby_watch(spark.read.parquet(str(stored / "species")), spark.read.parquet(str(stored / "observation"))))
    scans = [x for x in re.findall(r"PushedFilters: \[(.*?)\]\n", text)]
    assert any("GreaterThanOrEqual(lat" in x and "LessThanOrEqual(lon" in x and "StringStartsWith(species" in x for x in scans)
    read = re.findall(r"ReadSchema: struct<(.*?)>\n", text)
    assert not any("thumbnail" in x or "mass_grams" in x for x in read)
    assert "Window" not in text


def test_scan_prunes_predicate_partitions(spark, stored):
    graph = graph_files.read_graph(spark, str(stored / "graph"))
    text = plan(scan(graph, p=v.FAMILY))
    assert re.search(r"PartitionFilters: \[.*p#\d+ = http", text)


def test_rules_read_only_their_predicates_of_the_graph(spark, stored):
    graph = graph_files.read_graph(spark, str(stored / "graph"))
    text = plan(inference.migration_rule(graph))
    filters = re.findall(r"PartitionFilters: \[(.*?)\]\n", text)
    assert filters and all(re.search(r"p#\d+ (= |IN )", x) for x in filters)


def test_recent_limits_before_names(spark, stored):
    text = plan(queries.recent_observations(
        spark.read.parquet(str(stored / "species")), spark.read.parquet(str(stored / "observation")), limit=queries.RECENT_LIMIT))
    assert "TakeOrderedAndProject" in text and text.index("TakeOrderedAndProject") > text.index("LeftOuter")


def test_month_masks_stay_in_hash_aggregates(spark, stored):
    text = plan(inference.migration_facts(spark.read.parquet(str(stored / "observation"))))
    assert "HashAggregate" in text and "ObjectHashAggregate" not in text and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["nearby_watch", "find_by_name_full", "map_extract", "occurrence_triples", "fold_traits", "sessions", "history_trim"])
def test_no_python_and_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for word in ("Python", "Cartesian", "BroadcastNestedLoopJoin", "InMemoryTableScan"):
        assert word not in text


def test_latest_per_key_is_aggregated_before_the_shuffle(spark, stored):
    t = Tables(spark, FOLDER)
    text = plan(occurrences.capped_newest_first(t.occurrences))
    assert "partial_min_by" in text


def code():
    found = [p for folder in ("fieldlark", "checks") for p in (ROOT / folder).rglob("*.py")] + [ROOT / "__spark_entry__.py"]
    return [p for p in found if "llm" not in p.parts]  # a package with tests of its own


def test_library_rules():
    for path in code():
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".toPandas(", "collect_set(", ".rdd", "@udf", "pandas_udf", ".persist("):
            assert word not in text, (path, word)
    hinted = [p.name for p in code() if "F.broadcast(" in p.read_text()]
    assert sorted(hinted) == ["quality.py", "queries.py"]  # ontology terms, five labels
    for path in code():
        assert not re.search(r"\._(jdf|jsparkSession|jvm|jsc)\b", path.read_text()), path


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


class Configured:
    """A session whose settings name a checkpoint folder."""

    def __init__(self, folder):
        self.conf = {session.CHECKPOINT_KEY: folder}


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    assert session.scratch_path(Configured("/shared/ck/"), "x").startswith("/shared/ck/fieldlark-x-")
    root = session.checkpoint_root(spark)
    assert session.checkpoint_root(spark) == root  # local: one folder per session
    assert session.cut_lineage(spark.range(3), "x").count() == 3


def test_facade_reads_stored_tables(spark, tmp_path):
    folder = str(tmp_path / "kg")
    KnowledgeGraph(Tables(spark, FOLDER).derived_graph()).save(folder)
    kg = KnowledgeGraph.load(spark, folder)
    near = plan(kg.nearby_watch(radius_km=25.0))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]\n", near)
    assert any("GreaterThanOrEqual(lat" in x and "LessThanOrEqual(lon" in x for x in pushed) and "/triples" not in near
    family = plan(kg.species_by_family("family1"))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]\n", family)
    assert any("EqualTo(rank,family)" in x and "StringContains(lower,family1)" in x for x in pushed) and "/triples" not in family
    found = plan(kg.find_species_by_name("x"))
    assert "folded_compat" in found and "translate" not in found
    derived = KnowledgeGraph.load(spark, f"{folder}/triples", form="parquet")
    for ask in (lambda g: g.nearby_watch(radius_km=25.0), lambda g: g.species_by_family("family1"), lambda g: g.find_species_by_name("fugl"),
                lambda g: g.recent_observations("fugl"), lambda g: g.currently_present(6), lambda g: g.observations_for_map(order_filter="order")):
        assert sorted(map(str, ask(kg).collect())) == sorted(map(str, ask(derived).collect()))
    text = plan(derived.species_by_family("family1"))
    assert "wingspanMm" not in text and "massGrams" not in text


def test_only_the_named_tables_are_saved_and_the_others_are_derived(spark, triples, tmp_path):
    graph = KnowledgeGraph(triples(two_species()), V)
    path = str(tmp_path / "graph")
    graph.save(path, ["taxa"])
    assert sorted(p.name for p in (tmp_path / "graph").iterdir()) == ["taxa", "triples"]
    loaded = KnowledgeGraph.load(spark, path, V, tables=["taxa"])
    assert set(loaded.tables) == {"taxa"} and loaded.is_distinct
    assert rows(loaded.taxa_below(V.taxon("family/Picidae")), "node") == [V.taxon("species/euwoo1")]
    loaded.save_tables(path, ["species"])
    again = KnowledgeGraph.load(spark, path, V, tables=["taxa", "species"])
    assert rows(again.species("scientific_name"), "scientific_name") == rows(graph.species("scientific_name"), "scientific_name")
    with pytest.raises(ValueError):
        graph.save(path + "2", ["nests"])


def test_the_given_graph_holds_each_triple_once_and_is_written_without_a_distinct(spark, monkeypatch):
    flags = []

    def write(rows, path, distinct=False):
        flags.append(distinct)
        graph_files.write_graph(rows, path, distinct)

    monkeypatch.setattr(tables, "write_graph", write)
    monkeypatch.setattr(tables, "STORED", {})
    graph = Tables(spark, FOLDER).graph
    assert flags == [True] and graph.count() == graph.distinct().count()


def test_observation_rows_are_gathered_behind_the_shuffle(spark, triples):
    """No map task sorts or holds the values that it reads."""
    rows_of = observation_table(triples(two_species()), V)
    plan = rows_of._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "LocalTableScan" in line:
            up = [x.strip(" +-:*") for x in reversed(lines[:at])]
            below = up[:next(i for i, x in enumerate(up) if x.startswith("Exchange"))]
            assert not any("Aggregate" in x or x.startswith("Sort") for x in below), plan
    assert rows_of.count() == 2
