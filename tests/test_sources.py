import json

import pytest
from pyspark.sql import Observation, functions as F

from fieldlark import KnowledgeGraph
from fieldlark.model import ontology, types, vocab as v
from fieldlark.model.vocab import DEFAULT as V, Vocab
from fieldlark.operators import enrichment as en, occurrences as occ
from fieldlark.sources import graph_files, landed
from fieldlark.streaming import live
from tests.conftest import iri, rows, text, two_species


def test_ontology(spark):
    graph = ontology.ontology_triples(spark)
    assert graph.count() == graph.distinct().count() == 200
    assert ontology.classes(spark).count() == 7 and ontology.subclass_of(spark).count() == 4
    assert rows(ontology.properties(spark).groupBy("kind").count()) == [("datatype", 32), ("object", 3)]


def test_base_address_is_a_parameter(spark, triples):
    other = Vocab("https://my.example/")
    facts = [iri(other.taxon("species/a"), v.TYPE, other.term("Species")), text(other.taxon("species/a"), v.SCIENTIFIC_NAME, "A a"),
             iri(other.taxon("species/a"), other.has_observation, other.observation("1"))]
    assert KnowledgeGraph(triples(facts), other).list_observed_species().count() == 1
    assert KnowledgeGraph(triples(facts)).list_observed_species().count() == 0


AWKWARD = ['plain', 'quote " and \\ backslash', "line\nbreak\r\ttab", "\\n is not a break", 'ends with \\', "naïve 😀 ø", "", "a\\\"b", "it's"]


def test_ntriples_round_trip(spark, triples, tmp_path):
    facts = [text(f"http://s/{i}", "http://p", x) for i, x in enumerate(AWKWARD)]
    facts += [text("http://s", "http://p", "hej", "da"), text("http://s", "http://p", "5", datatype=v.INTEGER),
              iri("http://s", "http://p", "http://o"), iri("_:b1", "http://p", "_:b2")]
    path = str(tmp_path / "g.nt")
    graph_files.write_ntriples(triples(facts), path)
    assert rows(graph_files.read_ntriples(spark, path)) == sorted(facts, key=repr)
    assert KnowledgeGraph.load(spark, path, form="ntriples").triples.count() == len(facts)


@pytest.mark.parametrize("line, expected", [
    (r'<s> <p> "café \U000000e9 it\'s" .', "café é it's"), ('<s> <p> "x"^^<http://www.w3.org/2001/XMLSchema#string> . # note', "x"),
    ("  <s>\t<p>  <o>.", "o"), ('<s> <p> "broken .', None), (r'<s> <p> "\U0001F426 \uD83D\uDC26 \\U0001F426" .', "🐦 🐦 \\U0001F426"), (r'<s> <p> <http://x/\u00e9\U0001F426> .', "http://x/é🐦"),
    (r'<s> <p> "bad \U0001F4 x" .', None), (r'<s> <p> "bad \q" .', None), (r'<s> <p> "bad \U00110000" .', None), ("<s> <p> _:b2.", "_:b2"), ("junk", None), ('<s> <p> "\\\\\\"" .', '\\"'),
])
def test_ntriples_lines(spark, line, expected):
    parsed = graph_files.parse_ntriples(spark.createDataFrame([(line,), ("# comment",), ("",)], "value string")).collect()
    assert len(parsed) == 1
    assert parsed[0].o == expected and (parsed[0].bad_line is None) == (expected is not None)
    assert expected is None or parsed[0].o_datatype == ""


def test_parquet_round_trip_and_no_overwrite(spark, triples, tmp_path):
    path = str(tmp_path / "g")
    graph = KnowledgeGraph(triples(two_species() + two_species()))
    graph.save(path)
    assert rows(KnowledgeGraph.load(spark, path).triples) == sorted(set(two_species()), key=repr)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        graph.save(path)


def test_corrupt_lines_are_counted_and_skipped(spark, tmp_path):
    good = {"speciesCode": "robi", "category": "species", "comName": "Rødhals"}
    (tmp_path / "locale=da").mkdir()
    (tmp_path / "locale=da" / "x.json").write_text("\n".join([json.dumps(good), "{oops", json.dumps({"other": 1})]))
    one_folder = str(tmp_path / "locale=da")
    report = landed.input_report(landed.read_json(spark, one_folder, types.LOCALIZED_NAME_RECORD)).first()
    assert (report.n_valid, report.n_corrupt, report.n_empty) == (2, 1, 1)
    names = landed.read_localized_names(spark, str(tmp_path)).where("speciesCode is not null")
    assert rows(names, "speciesCode", "comName", "locale") == [("robi", "Rødhals", "da")]


def test_occurrence_filters(spark, tmp_path):
    base = {"key": 1, "datasetKey": landed.DATASET_KEY, "basisOfRecord": landed.BASIS_OF_RECORD, "scientificName": "A a"}
    for year, change in ((2023, {}), (2024, {"key": 2}), (2024, {"key": 3, "datasetKey": "other"}), (2024, {"key": 4, "basisOfRecord": "FOSSIL"})):
        folder = tmp_path / f"year={year}"
        folder.mkdir(exist_ok=True)
        (folder / f"{change.get('key', 1)}.json").write_text(json.dumps({**base, **change}))
    assert rows(landed.read_occurrences(spark, str(tmp_path)), "key", "year") == [(1, 2023), (2, 2024)]
    assert rows(landed.read_occurrences(spark, str(tmp_path), years=(2024, 2024)), "key") == [2]
    assert rows(landed.read_occurrences(spark, str(tmp_path), None, None), "key") == [1, 2, 3, 4]


def test_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps({"results": [{"key": i}, {"key": i + 1}], "endOfRecords": i == 3}) for i in (1, 3)))
    assert rows(landed.read_occurrence_pages(spark, str(tmp_path)), "key") == [1, 2, 3, 4]


def binding(**values):
    return {k: {"type": "literal", "value": x} for k, x in values.items()}


def test_bindings_keep_file_order_and_skip_bad_files(spark, tmp_path):
    batches = [[binding(name="A a", mass="1", itemLabel="one"), binding(name="A a", mass="2")], [binding(name="A a", mass="3")]]
    for i, batch in enumerate(batches):
        (tmp_path / f"b{i}.json").write_text(json.dumps({"results": {"bindings": batch}}, indent=1))
    (tmp_path / "b2.json").write_text("{ failed")
    folded = en.fold_traits(landed.read_trait_bindings(spark, str(tmp_path))).first()
    assert (folded.mass_g, folded.label, folded.diel) == (3.0, "one", None)


def test_sightings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"speciesCode": "robi", "obsDt": "2024-04-10", "howMany": 2}))
    assert landed.read_sightings(spark, str(tmp_path)).first().howMany == 2
    assert landed.read_sightings(spark, str(tmp_path), days=5).count() == 0


def test_iucn_lookups(spark, tmp_path):
    record = {"taxon": {"scientific_name": "A a"}, "assessments": [{"latest": True, "assessment_id": 5}]}
    (tmp_path / "l.json").write_text(json.dumps(record))
    assert rows(en.latest_assessment(landed.read_iucn_lookups(spark, str(tmp_path)))) == [("A a", 5)]


def test_literals_of_any_length(spark, triples, tmp_path):
    long = ["x" * 200_000, '"\\\n' * 60_000, "🐦é" * 50_000]
    facts = [text(f"http://s/{i}", "http://p", x) for i, x in enumerate(long)]
    path = str(tmp_path / "long.nt")
    graph_files.write_ntriples(triples(facts), path)
    assert rows(graph_files.read_ntriples(spark, path)) == sorted(facts, key=repr)


def test_bad_lines_are_an_error_or_counted(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<s> <p> <o> .\njunk\n# note\n<s> <p> "x" .\n')
    path = str(tmp_path / "g.nt")
    with pytest.raises(Exception, match="not a line of N-Triples: junk"):
        graph_files.read_ntriples(spark, path).collect()
    assert graph_files.read_ntriples(spark, path, strict=False).count() == 2
    assert tuple(graph_files.ntriples_report(spark, path).first()) == (2, 1)


def test_every_reader_can_be_counted(spark, tmp_path):
    lines = {
        "taxonomy": [{"speciesCode": "robi"}], "names": [{"speciesCode": "robi"}], "lookups": [{"taxon": {"scientific_name": "A a"}}],
        "assessments": [{"assessment_id": 5}], "sightings": [{"speciesCode": "robi"}], "occurrences": [{"key": 1}], "pages": [{"results": [{"key": 1}]}],
        "bindings": [{"results": {"bindings": [binding(name="A a")]}}],
    }
    for name, records in lines.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(map(json.dumps, records)) + ("" if name == "bindings" else "\n{oops"))
    readers = {
        "taxonomy": landed.read_taxonomy, "names": landed.read_localized_names, "lookups": landed.read_iucn_lookups,
        "assessments": landed.read_iucn_assessments, "sightings": landed.read_sightings, "pages": landed.read_occurrence_pages,
        "occurrences": lambda s, p: landed.read_occurrences(s, p, None, None), "bindings": landed.read_trait_bindings}
    for name, read in readers.items():
        assert read(spark, str(tmp_path / name)).count() == 1, name
    (tmp_path / "pictures").mkdir()
    (tmp_path / "pictures" / "x.json").write_text(json.dumps({"results": {"bindings": [binding(item="http://i", thumb="http://t")]}}))
    assert rows(landed.read_picture_bindings(spark, str(tmp_path / "pictures")), "item", "thumb") == [("http://i", "http://t")]


def test_counts_of_json_numbers_and_texts(spark, tmp_path):
    counts = [2, 2.0, 3.7, "4", "5.0", "many", None, " 6 ", -1.5]
    (tmp_path / "o.json").write_text("\n".join(json.dumps({"key": i, "individualCount": c}) for i, c in enumerate(counts, 1)))
    records = landed.read_occurrences(spark, str(tmp_path), None, None)
    count = occ.individual_count(F.col("individualCount"), records.schema["individualCount"].dataType)
    assert [r.n for r in records.orderBy("key").select(count.alias("n")).collect()] == [2, 2, 3, 4, None, None, None, 6, -1]


def test_stream_leaves_malformed_lines_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.json").write_text('{"speciesCode": "robi"}\n{oops\n')
    seen = live.run_available(landed.stream_sightings(spark, str(tmp_path / "in")), "sightings")
    assert rows(seen, "speciesCode") == ["robi"]


ODD = "".join(map(chr, range(1, 128)))


def test_any_iri_is_written_so_that_it_is_read_back(spark, triples, tmp_path):
    names = [f"http://x/a{sign}b" for sign in ODD] + ["", "_:b1", "_:b 1", "_:", "_:a.", "_:\nx", "http://x/é🐦 ", "http://x/\x00"]
    facts = [(s, p, o, "iri", "", "") for s, p, o in zip(names, names[1:] + names[:1], names[2:] + names[:2])]
    facts += [("s", "p", f"text{sign}", "literal", "", f"http://t/{sign}") for sign in ODD] + [("s", "p", "\x00 a", "literal", "da-DK", "")]
    graph_files.write_ntriples(triples(facts), str(tmp_path / "nt"))
    assert rows(graph_files.read_ntriples(spark, str(tmp_path / "nt"))) == sorted(set(facts), key=repr)


def test_a_language_tag_that_is_none_is_not_written(triples, tmp_path):
    with pytest.raises(Exception, match="not a language tag: da DK"):
        graph_files.write_ntriples(triples([("s", "p", "o", "literal", "da DK", "")]), str(tmp_path / "nt"))


READERS = {
    "taxonomy": landed.read_taxonomy, "sightings": landed.read_sightings, "iucn_assessments": landed.read_iucn_assessments,
    "iucn_lookups": landed.read_iucn_lookups, "occurrence_pages": landed.read_occurrence_pages,
}


@pytest.mark.parametrize("kind", READERS)
def test_readers_count_or_refuse_what_does_not_parse(spark, tmp_path, kind):
    first = landed.KINDS[kind][0].names[0]
    (tmp_path / "x.json").write_text("\n".join(['{"' + first + '": null}', "{oops", '{"none": 1}', "[}"]))
    counts = Observation("counts")
    assert READERS[kind](spark, str(tmp_path), counts=counts).count() in (2, 0)  # pages without results have no rows
    assert counts.get == {"n_read": 4, "n_bad": 2}
    with pytest.raises(Exception, match=r"does not parse: (\{oops|\[\})"):
        READERS[kind](spark, str(tmp_path), strict=True).collect()
    report = landed.reader_report(spark, {kind: str(tmp_path)}).first()
    assert tuple(report) == (kind, 2, 2, 2, 1)


def test_bindings_files_are_counted(spark, tmp_path):
    good = {"results": {"bindings": [{"item": {"type": "uri", "value": "a"}}] * 2}}
    (tmp_path / "1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "2.json").write_text('{"results": {')
    counts = Observation("files")
    assert landed.read_bindings(spark, str(tmp_path), counts=counts).count() == 2
    assert counts.get == {"n_read": 2, "n_bad": 1}
    with pytest.raises(Exception, match="does not parse"):
        landed.read_picture_bindings(spark, str(tmp_path), strict=True).collect()
    assert tuple(landed.reader_report(spark, {"bindings": str(tmp_path)}).first()) == ("bindings", 1, 1, 0, 1)


def test_ntriples_are_written_compressed_in_files_of_bounded_length(spark, triples, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_files, "LINES_A_FILE", 300)
    facts = [iri(f"http://s.example.org/{i}", "http://p.example.org/link", f"http://o.example.org/{i}") for i in range(1000)]
    for name, given, distinct in (("known", facts, True), ("looked for", facts + facts, False)):
        path = tmp_path / name
        graph_files.write_ntriples(triples(given).coalesce(1), str(path), distinct)
        files = [p for p in path.iterdir() if p.name.startswith("part-")]
        text_bytes = sum(len(r.value) + 1 for r in graph_files.ntriples_lines(triples(facts)).collect())
        assert len(files) >= 4 and sum(p.stat().st_size for p in files) * 5 < text_bytes
        assert spark.read.text(str(path)).count() == len(facts)
        assert rows(graph_files.read_ntriples(spark, str(path))) == sorted(facts, key=repr)
    # what is read is shuffled before copies are looked for
    lines = graph_files.read_ntriples(spark, str(path))._jdf.queryExecution().executedPlan().toString().splitlines()
    below = lines[next(i for i, line in enumerate(lines) if "Exchange" in line):]
    assert not any("Aggregate" in line for line in below)
