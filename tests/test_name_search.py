"""Search by trigrams against a scan of all names."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import queries, trigrams
from tests.test_plans import plan

SCHEMA = "species string, kind string, name string"
NAMES = [
    ("s1", "common_name_en", "European Robin"), ("s1", "common_name_da", "Rødhals"), ("s1", "common_name_fr", "Rouge-gorge familier"),
    ("s2", "common_name_fr", "Épervier d'Europe"), ("s3", "common_name_fr", "épervier"), ("s4", "scientific_name", "ROBINIA x"),
    ("s5", "common_name_en", "Ro"), ("s6", "common_name_en", ""), ("s7", "common_name_en", "日本語の鳥"), ("s8", "common_name_en", "🐦🐦🐦 bird"),
    ("s9", "common_name_en", "aaaa aaaa"), ("s10", "common_name_da", "Ærø, lille æ"), ("s11", "common_name_en", "line\nend"),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(2)
    many = [(f"r{i}", draw.choice(queries.NAMES), " ".join(
        "".join(draw.choice("aeébcdñ") for _ in range(draw.randrange(1, 6))) for _ in range(3))) for i in range(300)]
    names = queries.name_table(spark.createDataFrame(NAMES + many, SCHEMA))
    path = str(tmp_path_factory.mktemp("index"))
    trigrams.write_index(names, path)
    return names.cache(), trigrams.TrigramIndex.load(spark, path)


def scan(names, part, fold, kinds=None):
    from fieldlark.functions import text
    hit = F.col("lower").contains(F.lower(F.lit(part))) | F.col(f"folded_{fold}").contains(text.fold_full(F.lit(part)))
    hit = hit if kinds is None else hit & F.col("kind").isin(kinds)
    return sorted(r.species for r in names.where(hit).select("species").distinct().collect())


@pytest.mark.parametrize("fold", ["compat", "full"])
@pytest.mark.parametrize("part", ["robin", "ROBIN", "épervier", "Épervier", "epervier", "bin", "aaa", "aaaa a", "ræ", "ro", "", "x", "日本語",
                                  "🐦🐦🐦", "no such name", "e\nen", "ærø", "aero", "abc", "éb", "bcd ", "d'Eur"])
def test_same_species_as_a_scan(stored, part, fold):
    names, index = stored
    assert sorted(r.species for r in index.find(part, fold).species.collect()) == scan(names, part, fold)


def test_kinds(stored):
    names, index = stored
    for kinds in (["common_name_fr"], queries.MAP_NAMES):
        assert sorted(r.species for r in index.find("perv", "full", kinds).species.collect()) == scan(names, "perv", "full", kinds)


def test_grams(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,), ("aaaa",), ("🐦é日x",)], "x string")
    got = [r.g for r in rows.select(
        trigrams.letters(F.col("x")).alias("l")).select(trigrams.grams(F.col("l")).alias("g")).collect()]
    assert got == [["abc", "bca", "cab"], [], [], [], ["aaa", "aaa"], ["🐦é日", "é日x"]]


def test_only_files_of_the_trigrams_and_the_candidates_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "NAMES_A_BUCKET", 4)
    names = queries.name_table(spark.createDataFrame(NAMES, SCHEMA))
    buckets = trigrams.write_index(names, str(tmp_path))
    index = trigrams.TrigramIndex.load(spark, str(tmp_path))
    assert buckets > 1
    found = index.find("hals")
    assert len(found.buckets) == 1 and [r.species for r in found.species.collect()] == ["s1"]
    folders = re.findall(r"PartitionFilters: \[(.*?)\]\n", plan(found.species))
    assert any("bucket" in x and str(found.buckets[0]) in x for x in folders)
    text = plan(index.candidates("hals", "lower"))
    assert any("gram_bucket" in x for x in re.findall(r"PartitionFilters: \[(.*?)\]\n", text)) and "EqualTo(gram," in text


def test_no_names(spark, tmp_path):
    trigrams.write_index(queries.name_table(spark.createDataFrame([], SCHEMA)), str(tmp_path))
    index = trigrams.TrigramIndex.load(spark, str(tmp_path))
    assert index.find("abc").species.isEmpty() and index.find("a").species.isEmpty()


def test_bucket_count_grows_with_the_names():
    assert [trigrams.bucket_count(n) for n in (0, 99_999, 100_000, 10**7, 10**12)] == [1, 1, 2, 128, trigrams.MOST_BUCKETS]


def test_postings_are_those_of_all_runs_and_each_run_of_a_text_is_made_once(spark):
    texts = ["Épervier à gros  bec", "a𝒳 b𝒴𝒵 c", "ab c\n d e", "nul\x00x yz", "a", "", None, "word word word word", "日本 語 テスト"]
    names = queries.name_table(spark.createDataFrame([(str(i), "k", x) for i, x in enumerate(texts)], SCHEMA)).cache()
    want = {}
    for row in names.collect():
        for i, form in enumerate(trigrams.FORMS):
            value = row[form] or ""
            for at in range(len(value) - 2):
                key = value[at:at + 3], row.species
                want[key] = want.get(key, 0) | 1 << i
    got = trigrams.posting_table(names, 4).collect()
    assert {(r.gram, r.species): r.forms for r in got} == want and len(got) == len(want)
    repeated = spark.createDataFrame([("word " * 1000,)], "x string").select(F.size(trigrams.runs(F.col("x"))).alias("n")).first()
    assert repeated.n == 5


def test_the_index_shuffles_each_name_once_and_no_posting(spark, tmp_path):
    """Forms and postings are made where names are read, behind the only shuffle."""
    names = queries.name_table(spark.createDataFrame(NAMES * 3, SCHEMA))
    assert "Exchange" not in plan(trigrams.posting_table(names, 4))
    trigrams.write_index(names, str(tmp_path), 2)
    store = spark._jsparkSession.sharedState().statusStore()
    kept = store.executionsList()  # the store keeps a number of them, so their count is no number of one
    last = sorted((kept.apply(i) for i in range(kept.size())), key=lambda x: x.executionId())[-3:]
    plans = [x.physicalPlanDescription() for x in last]
    stored, posted, _ = [re.sub(r"(?s)== Initial Plan ==.*?== ", "== ", x) for x in plans]
    assert "Exchange" not in posted and "Sort" not in posted and "InsertIntoHadoopFsRelationCommand" in posted
    moved = [x for x in re.findall(r"(?s)\(\d+\) Exchange.*?\n\n", stored)]
    assert moved and not any("folded" in x for x in moved)
    assert sorted(map(tuple, trigrams.TrigramIndex.load(spark, str(tmp_path)).names.select(names.columns).collect())) == sorted(map(tuple, names.collect()))


def test_forms_of_a_trigram(spark):
    """Each of the three forms may be spelt like another or not."""
    texts = ["abcd", "abcé", "abÉd", "abc日de", "éÉø", "Éé日abc", "ababab", "xé"]
    forms = [[f"a{x}b", f"a{y}b", f"a{z}b"] for x in "pqr" for y in "pqr" for z in "pqr"]
    names = queries.name_table(spark.createDataFrame([(str(i), "k", x) for i, x in enumerate(texts)], SCHEMA)).unionByName(
        spark.createDataFrame([(f"m{i}", "k", "", *x) for i, x in enumerate(forms)] + [("n", "k", "", None, "abc", None)],
                              "species string, kind string, name string, lower string, folded_compat string, folded_full string"))
    want = {}
    for row in names.collect():
        for i, form in enumerate(trigrams.FORMS):
            for at in range(len(row[form] or "") - 2):
                key = row[form][at:at + 3], row.species
                want[key] = want.get(key, 0) | 1 << i
    got = trigrams.posting_table(names, 4).collect()
    assert {(r.gram, r.species): r.forms for r in got} == want and len(got) == len(want)
