from fieldlark.model import vocab as v
from fieldlark.model.ontology import ontology_triples
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import quality as q
from tests.conftest import iri, rows, text, two_species


def graph(spark, triples, *more):
    return triples(two_species() + list(more)).unionByName(ontology_triples(spark))


def test_clean_graph_has_no_findings(spark, triples):
    g = graph(spark, triples)
    assert q.undeclared_classes(g).count() == 0
    assert q.undeclared_properties(g).count() == 0
    assert q.missing_superclasses(g).count() == 0
    assert q.blank_names(g).count() == 0
    assert q.dangling_references(g).count() == 0


def test_findings(spark, triples):
    g = graph(spark, triples, iri("x", v.TYPE, V.term("Clade")), text("x", V.term("nick"), "n"), text("x", "http://other/p", "n"),
              iri("y", v.TYPE, V.term("Species")), text("y", v.SCIENTIFIC_NAME, " \t"), iri("y", V.has_observation, "gone"))
    assert rows(q.undeclared_classes(g)) == [(V.term("Clade"), 1)]
    assert rows(q.undeclared_properties(g)) == [("http://other/p", 1), (V.term("nick"), 1)]
    assert rows(q.blank_names(g), "species") == ["y"]
    assert rows(q.dangling_references(g), "o") == ["gone"]
    assert q.missing_superclasses(triples(two_species())).count() == 4


def test_counts_and_shares(spark, triples):
    g = graph(spark, triples, iri("y", v.TYPE, V.term("Species")), text("y", v.SCIENTIFIC_NAME, "Y y"))
    assert rows(q.minimum_counts(g), "measure", "n", "ok") == [("Observation", 2, True), ("Species", 3, False)]
    assert rows(q.species_shares(g), "measure", "n_present", "n_all", "ok") == [
        ("common_name_en", 2, 3, False), ("scientific_name", 3, 3, True)]
    assert rows(q.observation_shares(g), "measure", "ok") == [("location", True), ("observed_on", True)]
    assert rows(q.observation_shares(triples([text("a", "b", "c")])), "measure", "ok") == [("location", False), ("observed_on", False)]
    assert q.triple_total(g, 10).first().ok and not q.triple_total(g).first().ok


def test_links_and_ranges(spark, triples):
    links = [iri(f"s{i}", v.SAME_AS, f"{v.WIKIDATA_ENTITY}Q{i}") for i in range(3)] + [text("s1", V.term("range"), "Europe")]
    limits = {"wikidata_links": 2, "wingspan": 0, "range": 0, "diel": 0}
    assert rows(q.link_counts(triples(links), limits), "measure", "n", "ok") == [
        ("diel", 0, False), ("range", 1, True), ("wikidata_links", 3, True), ("wingspan", 0, False)]
    table = spark.createDataFrame([("a", 5.0, 0.4), ("b", 4000.1, None), ("c", None, 200000.0)],
                                  "species string, wingspan_mm double, mass_grams double")
    assert rows(q.range_violations(table, "species")) == [("a", "mass_grams", 0.4), ("b", "wingspan_mm", 4000.1)]
