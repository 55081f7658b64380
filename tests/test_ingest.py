import datetime

import pytest
from pyspark.sql import functions as F

from fieldlark.model import types, vocab as v
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import occurrences as occ, taxonomy as tax
from fieldlark.operators.triples import scan
from fieldlark.plans.graph import build_graph
from fieldlark.session import small_table
from tests.conftest import rows


TAXA = [
    dict(seq=1, speciesCode="robi", category="species", sciName="Erithacus rubecula", comName="European Robin",
         order="Passeriformes", familySciName="Muscicapidae", familyComName="Flycatchers", taxonOrder=100.0),
    dict(seq=2, speciesCode="euwoo1", category="species", sciName="Dendrocopos major", comName="Great Spotted Woodpecker",
         order="Piciformes", familySciName="Picidae", familyComName="Woodpeckers", taxonOrder=50.5),
    dict(seq=3, speciesCode="", category="spuh", sciName="Aves sp.", comName="bird sp.", order="Strigiformes",
         familySciName="Strigidae", familyComName="", taxonOrder=None),
    dict(seq=4, speciesCode="robi2", category="species", sciName="Erithacus akahige", comName="Other", order="Other",
         familySciName="Muscicapidae", familyComName="Renamed", taxonOrder=101.0),
]
NAMES = [dict(speciesCode="robi", category="species", comName="Rødhals"), dict(speciesCode="robi", category="issf", comName="x"),
         dict(speciesCode="", category="species", comName="x"), dict(speciesCode="euwoo1", category="species", comName="")]


def frame(spark, records, schema):
    names = schema.fieldNames()
    return small_table(spark, [tuple(r.get(n) for n in names) for r in records], schema)


@pytest.fixture(scope="module")
def taxa(spark):
    return frame(spark, TAXA, types.TAXONOMY_RECORD).cache()


def test_nodes(taxa):
    assert rows(tax.order_nodes(taxa), "scientific_name") == ["Other", "Passeriformes", "Piciformes", "Strigiformes"]
    families = {r.scientific_name: r for r in tax.family_nodes(taxa).collect()}
    assert families["Muscicapidae"].common_name_en == "Flycatchers"
    assert families["Muscicapidae"].parent == V.taxon("order/Passeriformes")
    assert families["Strigidae"].common_name_en is None
    assert rows(tax.genus_nodes(taxa), "genus") == ["Dendrocopos", "Erithacus"]
    assert rows(tax.species_nodes(taxa), "ebird_code") == ["euwoo1", "robi", "robi2"]


def test_first_record_wins_in_any_row_order(taxa):
    shuffled = taxa.orderBy(F.desc("seq")).repartition(3)
    assert rows(tax.family_nodes(shuffled)) == rows(tax.family_nodes(taxa))
    assert rows(tax.taxonomy_triples(shuffled)) == rows(tax.taxonomy_triples(taxa))


def test_taxonomy_triples(taxa):
    graph = tax.taxonomy_triples(taxa)
    robin = V.taxon("species/robi")
    assert rows(scan(graph, s=robin), "p", "o") == sorted([
        (v.TYPE, V.term("Species")), (V.term("eBirdCode"), "robi"), (v.SCIENTIFIC_NAME, "Erithacus rubecula"),
        (V.term("commonNameEn"), "European Robin"), (V.parent_taxon, V.taxon("genus/Erithacus")), (v.GENUS, "Erithacus"),
        (v.FAMILY, "Muscicapidae"), (v.ORDER, "Passeriformes"), (V.term("taxonOrder"), "100.0"),
        (v.SAME_AS, "https://ebird.org/species/robi")], key=repr)
    assert scan(graph, p=v.TYPE, o=V.term("Species")).count() == 3
    assert scan(tax.taxonomy_triples(taxa, "da"), p=V.term("commonNameDa")).count() == 3
    assert graph.count() == graph.distinct().count()


def test_scientific_name_falls_back(spark):
    record = dict(seq=1, speciesCode="a", category="species", sciName="", scientificName="Aa bb")
    node = tax.species_nodes(frame(spark, [record], types.TAXONOMY_RECORD)).first()
    assert (node.scientific_name, node.genus, node.family) == ("Aa bb", "Aa", None)


def test_localized_names(spark):
    records = frame(spark, NAMES, types.LOCALIZED_NAME_RECORD)
    assert rows(tax.danish_name_triples(records), "o", "o_lang") == [("Rødhals", "da")]
    with pytest.raises(ValueError):
        tax.localized_name_triples(records, "de")


def record(**fields):
    base = dict(scientificName="Erithacus rubecula (Linnaeus, 1758)", seq=1)
    return {**base, **fields}


def observed(spark, *records):
    index = spark.createDataFrame([("Erithacus rubecula", "SP")], "scientific_name string, species string")
    resolved = occ.resolve_species(frame(spark, records, types.OCCURRENCE_RECORD), index)
    return occ.observations(resolved).collect()


def test_resolution(spark):
    matched, minted = observed(spark, record(key=1), record(key=2, scientificName=" Parus  major-x (L.) "))
    assert matched.species == "SP" and not matched.is_minted
    assert minted.species == V.taxon("species/sci/Parus__major_x__L") and minted.is_minted
    assert observed(spark, record(key=3, scientificName="  "), record(key=4, scientificName=None)) == []


@pytest.mark.parametrize("fields, expected", [
    (dict(key=42), "42"), (dict(key=0, gbifID="g1"), "g1"), (dict(gbifID=""), None), (dict(key=7, gbifID="g"), "7"),
])
def test_observation_ids(spark, fields, expected):
    import hashlib
    name = "Erithacus rubecula (Linnaeus, 1758)"
    digest = hashlib.md5(f"{name}2024-01-02None1e-05".encode()).hexdigest()[:12]
    got = observed(spark, record(eventDate="2024-01-02", decimalLongitude=1e-05, **fields))[0].obs_id
    assert got == V.observation(expected or digest)


@pytest.mark.parametrize("event, identified, expected", [
    ("2024-04-10T08:00:00", None, datetime.date(2024, 4, 10)), (None, "2023-01-01", datetime.date(2023, 1, 1)),
    ("", "2023-01-01", datetime.date(2023, 1, 1)), ("2024-02-30", "2023-01-01", None), ("2024", None, None),
    ("2024-04", None, None), ("junk", None, None), (None, None, None),
])
def test_observed_dates(spark, event, identified, expected):
    assert observed(spark, record(key=1, eventDate=event, dateIdentified=identified))[0].observed_on == expected


@pytest.mark.parametrize("raw, expected", [("2", 2), (" 3 ", 3), ("-1", -1), ("3.7", None), ("many", None), (None, None), ("", None)])
def test_counts_as_text(spark, raw, expected):
    assert observed(spark, record(key=1, individualCount=raw))[0].individual_count == expected


def test_counts_as_numbers_truncate(spark):
    df = spark.createDataFrame([(3.7,), (-2.9,)], "n double")
    assert rows(df.select(occ.individual_count(F.col("n"), df.schema["n"].dataType))) == [-2, 3]


def test_places(spark):
    placed, half = observed(
        spark, record(key=1, decimalLatitude=55.694, decimalLongitude=-12.554, locality="", verbatimLocality="Nørrebro"),
        record(key=2, decimalLatitude=1.0, locality="lost"))
    assert placed.loc_id == V.location("55p6940_N12p5540") and placed.locality == "Nørrebro"
    assert (half.loc_id, half.lat, half.locality) == (None, None, None)


def test_location_picks_one_point_per_cell(spark):
    facts = spark.createDataFrame([("b", "L", 1.00001, 2.0, "second"), ("a", "L", 1.00002, 2.0, "first"), ("c", None, None, None, None)],
                                  "obs_id string, loc_id string, lat double, lon double, locality string")
    assert rows(occ.locations(facts)) == [("L", 1.00002, 2.0, "first")]


def test_worst_status(spark):
    codes = ["LC", " en ", "EX", None, "VU", "??"]
    resolved = spark.createDataFrame(
        [("a", c) for c in codes] + [("b", "EX"), ("c", "NE")], "species string, iucnRedListCategory string")
    assert rows(occ.worst_status(resolved)) == [("a", "EN"), ("c", "NE")]


def test_occurrence_triples(spark):
    index = spark.createDataFrame([("Erithacus rubecula", "SP")], "scientific_name string, species string")
    records = frame(spark, [
        record(key=1, eventDate="2024-04-10", individualCount="2", decimalLatitude=55.694, decimalLongitude=12.554,
               locality="Nørrebro", recordedBy="A", speciesKey=9, iucnRedListCategory="LC"),
        record(key=2, scientificName="Novus avis", taxonKey=8, iucnRedListCategory="en")], types.OCCURRENCE_RECORD)
    graph = occ.occurrence_triples(records, index)
    by_subject = graph.groupBy("s").count().collect()
    minted = V.taxon("species/sci/Novus_avis")
    assert {r.s: r["count"] for r in by_subject} == {
        V.observation("1"): 7, V.location("55p6940_12p5540"): 4, "SP": 3, V.observation("2"): 3, minted: 5}
    assert rows(scan(graph, p=V.term("conservationStatus")), "s", "o") == sorted([("SP", "LC"), (minted, "EN")], key=repr)


def test_ingesting_twice_changes_nothing(spark, taxa):
    records = frame(spark, [record(key=1, eventDate="2024-04-10")], types.OCCURRENCE_RECORD)
    once = build_graph(taxa, {}, records)
    twice = build_graph(taxa.unionByName(taxa), {}, records.unionByName(records))
    assert rows(once) == rows(twice)


def years(spark, *pairs):
    return frame(spark, [dict(key=k, year=y, seq=i) for i, (k, y) in enumerate(pairs)], types.OCCURRENCE_RECORD)


@pytest.mark.parametrize("pairs, options, keys", [
    ([(1, 2020), (2, 2024), (3, 2022)], {}, [2, 3, 1]),
    ([(1, 2020), (1, 2024), (2, 2024)], {}, [1, 2]),
    ([(1, 2024), (2, 2024), (3, 2024), (4, 2023)], {"year_cap": 2}, [1, 2, 4]),
    ([(1, 2024), (2, 2023), (3, 2022)], {"max_records": 2}, [1, 2]),
    ([(None, 2024), (0, 2024), (5, 1990)], {}, [5]),
    ([(1, 2024), (2, 1990)], {"current_year": 2024}, [1]),
])
def test_capped_sample(spark, pairs, options, keys):
    sample = occ.capped_newest_first(years(spark, *pairs), **options)
    assert [r.key for r in sample.collect()] == keys


def test_build_graph(spark, taxa):
    names = frame(spark, NAMES, types.LOCALIZED_NAME_RECORD)
    graph = build_graph(taxa, {"da": names}, frame(spark, [record(key=1)], types.OCCURRENCE_RECORD))
    assert rows(scan(graph, p=V.has_observation), "s") == [V.taxon("species/robi")]
    assert rows(scan(graph, p=V.term("commonNameDa")), "o") == ["Rødhals"]
    assert scan(graph, p=v.TYPE, o=v.OWL + "Class").count() == 7


def test_taxonomy_looks_for_copies_behind_the_shuffle(taxa):
    """The triples of a map task are not held for a partial distinct."""
    plan = tax.taxonomy_triples(taxa)._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate" in line for line in plan[plan.index("Exchange"):plan.index("Union")].splitlines())
