import json

import pytest
from pyspark.sql import functions as F

from fieldlark.model import types, vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import enrichment as en
from fieldlark.operators.triples import missing_from, scan, union_graphs
from fieldlark.plans import graph as plans
from fieldlark.sources import landed
from tests.conftest import rows, two_species

TRAITS = "seq long, " + ", ".join(f"{c} string" for c in en.TRAIT_VARIABLES.values())


def traits(spark, *bindings):
    columns = list(en.TRAIT_VARIABLES.values())
    return spark.createDataFrame([(i, *[b.get(c) for c in columns]) for i, b in enumerate(bindings)], TRAITS)


def test_fold_keeps_first_ids_and_last_values(spark):
    folded = en.fold_traits(traits(
        spark,
        dict(name="A", item="http://x/none", item_label="first", mass="10", diel_label="diurnality", status_label="Q1"),
        dict(name="A", item="http://x/entity/Q5", item_label="second", mass="12.5", gbif_id="g", status_label="least concern"),
        dict(name="A", item="http://x/entity/Q6", mass="heavy", wingspan="1e2", diel_label="Q9", ebird_id=""),
        dict(name="", mass="1"), dict(name=None, mass="1"))).collect()
    assert len(folded) == 1
    assert folded[0].asDict() == dict(
        name="A", label="first", iucn_status="least concern", diel="diurnality", mass_g=12.5, wingspan_mm=100.0,
        gbif_id="g", ebird_id=None, wikidata_id="Q5")


@pytest.mark.parametrize("raw, expected", [("7", 7.0), (" .5", 0.5), ("1d", None), ("", None), ("n/a", None), ("-3.", -3.0)])
def test_numbers(spark, raw, expected):
    assert en.fold_traits(traits(spark, dict(name="A", mass=raw))).first().mass_g == expected


def test_units_are_a_parameter(spark):
    folded = en.fold_traits(traits(spark, dict(name="A", mass="2", wingspan="3")), mass_factor=1000.0, wingspan_factor=10.0)
    assert (folded.first().mass_g, folded.first().wingspan_mm) == (2000.0, 30.0)


def test_values_are_distinct_and_resolved(spark):
    rows_ = traits(spark, dict(name="A", habitat_label="forest", range_label="Europe"), dict(name="A", habitat_label="forest"),
                   dict(name="A", habitat_label="Q7"), dict(name="A", habitat_label="Queensland"), dict(name="B", habitat_label="bog"))
    assert rows(en.trait_values(rows_)) == [("A", "habitat", "forest"), ("A", "range", "Europe"), ("B", "habitat", "bog")]
    assert rows(en.value_coverage(en.trait_values(rows_))) == [("habitat", 2), ("range", 1)]


def test_fold_does_not_depend_on_row_order(spark):
    table = traits(spark, *[dict(name="A", mass=str(i), item=f"http://x/Q{i}", item_label=str(i)) for i in range(20)])
    assert rows(en.fold_traits(table.repartition(5))) == rows(en.fold_traits(table.orderBy(F.desc("seq"))))


def test_trait_triples_and_report(spark, triples):
    graph = triples(two_species())
    bindings = traits(
        spark, dict(name="Erithacus rubecula", item="http://x/Q9", mass="18", wingspan="220", diel_label="diurnality",
                    habitat_label="forest", range_label="Europe"),
        dict(name="Erithacus rubecula", habitat_label="garden"), dict(name="Nobody known", mass="1"))
    offered = plans.enrich_with_traits(graph, bindings)
    assert offered.count() == 7
    assert rows(scan(offered, p=v.SAME_AS), "s", "o") == [(V.taxon("species/robi"), v.WIKIDATA_ENTITY + "Q9")]
    assert en.enrichment_report(graph, offered).first() == (7, 7)
    merged = union_graphs(graph, offered)
    assert en.enrichment_report(merged, offered).first() == (7, 0)
    found = {r.habitat for r in plans.KnowledgeGraph(merged).find_species_by_name("robin").collect()}
    assert found == {"forest", "garden"}


def pictures(spark, *bindings):
    return spark.createDataFrame(
        [(i, b.get("item"), b.get("thumb"), b.get("range_map")) for i, b in enumerate(bindings)],
        "seq long, item string, thumb string, range_map string")


def test_pictures(spark, triples):
    graph = triples(two_species())
    robin = v.DBPEDIA_RESOURCE + "European_robin"
    offered = plans.enrich_with_pictures(graph, pictures(
        spark, dict(item=robin, thumb=""), dict(item=robin, thumb="http://t/1", range_map="Map.png"),
        dict(item=robin, thumb="http://t/2", range_map="http://m/2"), dict(item=v.DBPEDIA_RESOURCE + "Dodo", thumb="x"),
        dict(item=None, thumb="y")))
    assert rows(offered, "p", "o") == sorted([
        (V.term("thumbnailUrl"), "http://t/1"), (V.term("rangeMapUrl"), v.COMMONS_FILE + "Map.png"), (v.SAME_AS, robin)], key=repr)


def test_name_pairs_need_both_names(triples):
    facts = [f for f in two_species() if not (f[1] == V.term("commonNameEn") and "robi" in f[0])]
    assert rows(en.name_pairs(triples(facts)), "scientific_name") == ["Dendrocopos major"]


def test_slug_index_last_wins(spark):
    pairs = spark.createDataFrame([(1, "A a", "Big Bird"), (2, "B b", "Big bird"), (3, "C c", " ")],
                                  "seq int, scientific_name string, common_name_en string")
    assert rows(en.slug_index(pairs)) == [("Big_bird", "B b")]


LOOKUPS = [
    ("Aa aa", [("2019", False, 1), ("2022", True, 2)], 2), ("Bb bb", [("2019", False, 3), ("2020", None, 4)], 3),
    ("Cc cc", [("2019", True, 5), ("2022", True, 6)], 5), ("Dd dd", [], None), ("Single", [("2020", True, 7)], None),
    ("Ee ee", None, None), ("Ff ff", [("2019", False, 8), ("2022", True, None)], 8), ("", [("x", True, 9)], None),
]


def test_latest_assessment(spark):
    df = spark.createDataFrame(
        [(n, a) for n, a, _ in LOOKUPS],
        "name string, assessments array<struct<year_published:string,latest:boolean,assessment_id:long>>")
    assert rows(en.latest_assessment(df)) == sorted([(n, x) for n, _, x in LOOKUPS if x], key=repr)


def test_latest_of_rows(spark):
    df = spark.createDataFrame([("a", 1, False, 10), ("a", 2, True, 20), ("a", 3, True, 30), ("b", 5, None, 50), ("b", 4, False, 40)],
                               "k string, seq int, latest boolean, assessment_id long")
    assert rows(en.latest_assessment_of_rows(df, "k")) == [("a", 20), ("b", 40)]


ASSESSMENT = {
    "assessment_id": 2, "red_list_category": {"code": "LC", "description": {"en": "Least Concern"}},
    "population_trend": {"code": "0", "description": {"en": "Increasing"}},
    "supplementary_info": {"movement_patterns": "Full Migrant"},
    "habitats": [{"description": {"en": "Forest"}, "suitability": "Suitable", "season": "Breeding", "majorImportance": "Yes"},
                 {"description": {"en": ""}}, {"description": {"fr": "Marais"}}, {"description": {"en": "Bog"}}, {}],
    "threats": [{"description": {"en": "Hunting"}, "scope": "Minority", "severity": "Slow", "timing": "Ongoing"}],
    "systems": [{"description": {"en": "Terrestrial"}}, {"description": None}],
}


@pytest.fixture()
def assessed(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([json.dumps(ASSESSMENT), json.dumps({"assessment_id": 3}), "{broken"]))
    return landed.read_iucn_assessments(spark, str(tmp_path))


def test_flatten_assessment(assessed):
    full, empty = en.flatten_assessment(assessed).orderBy("assessment_id").collect()
    assert (full.category, full.population_trend, full.movement, full.systems) == ("LC", "Increasing", "Full Migrant", ["Terrestrial"])
    assert [tuple(h) for h in full.habitats] == [("Forest", "Suitable", "Breeding", True), ("Bog", None, None, False)]
    assert [tuple(t) for t in full.threats] == [("Hunting", "Minority", "Slow", "Ongoing")]
    assert (empty.category, empty.habitats, empty.movement) == (None, None, None)


def test_assessment_triples(spark, triples, assessed):
    lookups = spark.createDataFrame(
        [("Erithacus rubecula", [("2022", True, 2)]), ("Dendrocopos major", [("2022", True, 3)]), ("Un known", [("2022", True, 2)])],
        "name string, assessments array<struct<year_published:string,latest:boolean,assessment_id:long>>")
    offered = plans.enrich_with_assessments(triples(two_species()), lookups, assessed)
    assert rows(offered, "p", "o") == sorted([
        (V.term("iucnCategory"), "LC"), (V.term("populationTrend"), "Increasing"), (V.term("movementPattern"), "Full Migrant"),
        (V.term("iucnHabitat"), "Forest"), (V.term("iucnHabitat"), "Bog"), (V.term("threat"), "Hunting"),
        (V.term("system"), "Terrestrial")], key=repr)
    assert {r.s for r in offered.collect()} == {V.taxon("species/robi")}
    # 'Dendrocopos major' comes first by name
    assert plans.enrich_with_assessments(triples(two_species()), lookups, assessed, limit=1).count() == 0


def test_missing_from_ignores_what_is_held(triples):
    graph = triples(two_species())
    assert missing_from(graph, graph).count() == 0
