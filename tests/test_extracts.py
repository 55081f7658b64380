import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import extracts as ex, grouping
from tests.conftest import rows


def at(*hms):
    return datetime.datetime(2024, 1, 1, *hms)


def brute_sessions(log, gap):
    out = []
    for key in {k for k, _ in log}:
        times = sorted(t for k, t in log if k == key)
        current = [times[0]]
        for t in times[1:]:
            if (t - current[-1]).total_seconds() >= gap:
                out.append((key, current[0], current[-1], len(current)))
                current = []
            current.append(t)
        out.append((key, current[0], current[-1], len(current)))
    return sorted(out, key=repr)


def test_sessions_split_at_exactly_the_pause(spark):
    log = [("a", at(0, 0)), ("a", at(1, 59, 59)), ("a", at(4, 0, 0)), ("a", at(6, 0, 0)), ("b", at(3, 0))]
    df = spark.createDataFrame(log, "k string, ts timestamp")
    assert rows(ex.sessions(df, "k", "ts"), "k", "started", "ended", "n") == brute_sessions(log, 7200)


def test_sessions_of_a_busy_key(spark):
    generator = random.Random(11)
    start = datetime.datetime(2023, 12, 31)
    log = [(generator.choice("aaaab"), start + datetime.timedelta(seconds=generator.randrange(0, 2_000_000))) for _ in range(900)]
    df = spark.createDataFrame(log, "k string, ts timestamp")
    assert rows(ex.sessions(df, "k", "ts"), "k", "started", "ended", "n") == brute_sessions(log, 7200)


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([("a", at(0)), ("b", at(0, 0, 1)), ("a2", at(0)), ("a2", at(1))], "k string, ts timestamp")
    assert rows(ex.expired_sessions(df, "k", "ts", F.lit(at(2, 0, 1))), "k") == ["a"]


@pytest.mark.parametrize("length, kept", [(3, 3), (41, 41), (42, 41), (90, 41)])
def test_history(spark, length, kept):
    df = spark.createDataFrame([("c", i, f"m{i}") for i in range(length)], "conv string, turn int, text string")
    turns = rows(ex.history_trim(df, "conv", "turn"), "turn")
    assert sorted(turns) == sorted({0, *range(max(0, length - 40), length)}) and len(turns) == kept


def test_top_per_key_equals_a_plain_window(spark):
    generator = random.Random(2)
    data = [("hot" if generator.random() < 0.7 else f"k{generator.randrange(5)}", generator.randrange(1000), i) for i in range(800)]
    df = spark.createDataFrame(data, "k string, x int, i int").repartition(7)
    got = rows(grouping.top_per_key(df, ["k"], [F.asc("x"), F.asc("i")], 10, ["i"]))
    best = [r for k in {d[0] for d in data} for r in sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))[:10]]
    assert got == sorted(best, key=repr)


def test_pick_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, i int, t string")
    assert rows(grouping.pick_first(df, ["k"], [F.col("i")])) == [("a", 1, "y"), ("b", 5, None)]


def test_thumbnails(spark):
    def item(**fields):
        return fields
    results = [
        ("s", 1, json.dumps([item(thumbnail="http://a", commonNameEn="En", commonNameFr="Fr"), item(thumbnail="ftp://x"), item()])),
        ("s", 2, json.dumps([item(thumbnail="http://a", commonNameEn="Other"), item(thumbnail="http://b", commonNameFr="Fr")])),
        ("s", 3, "not json"), ("s", 4, json.dumps(item(thumbnail="http://z"))), ("s", 5, None),
        ("s", 6, json.dumps([item(thumbnail=f"http://{c}", scientificName=c) for c in "cdef"])),
        ("t", 1, json.dumps([item(thumbnail="http://a")])),
    ]
    df = spark.createDataFrame(results, "answer string, seq int, result string")
    got = ex.thumbnails(df, ["answer"], "seq").orderBy("answer", "seq", "position").select("answer", "name", "url").collect()
    assert [tuple(r) for r in got] == [
        ("s", "En", "http://a"), ("s", "Fr", "http://b"), ("s", "c", "http://c"), ("s", "d", "http://d"), ("t", "", "http://a")]


def test_result_cap_counts_the_rest(spark):
    df = spark.range(60).withColumn("name", F.concat(F.lit("n"), F.lpad("id", 3, "0")))
    capped = ex.result_cap(df, [F.col("id").asc()])
    assert capped.count() == 25 and {r.left_out for r in capped.collect()} == {35}
    assert json.loads(capped.orderBy("position").first()["row"]) == {"id": 0, "name": "n000"}
    assert {r.left_out for r in ex.result_cap(df, [F.col("id").asc()], 60).collect()} == {0}


def sightings(spark):
    return spark.createDataFrame(
        [("robi", "Robin", "Erithacus rubecula", "2024-04-10 08:00", "Park", 55.0, 12.0, 2),
         ("x", None, None, "2024-03-01", None, None, None, None)],
        "speciesCode string, comName string, sciName string, obsDt string, locName string, lat double, lng double, howMany int")


def test_live_sightings(spark):
    assert rows(ex.live_sightings(sightings(spark))) == [
        ("", "", "2024-03-01", "", None, None, "X"), ("Robin", "Erithacus rubecula", "2024-04-10 08:00", "Park", 55.0, 12.0, "2")]


@pytest.mark.parametrize("days, kept", [(14, 1), (0, 0), (1, 0), (99, 1)])
def test_recent_sightings_with_the_days_of_an_endpoint(spark, days, kept):
    today = F.lit("2024-04-12").cast("date")
    assert ex.recent_sightings(sightings(spark), today, ex.clamp_days(days)).count() == kept


def test_live_flag(spark):
    expected = spark.createDataFrame([("a", "robi"), ("b", "nope"), ("c", None)], "species string, ebird_code string")
    assert rows(ex.live_flag(expected, sightings(spark)), "species", "is_live") == [("a", True), ("b", False), ("c", False)]


def test_status_histogram(spark):
    df = spark.createDataFrame([("a", "LC"), ("b", "LC"), ("c", "CR"), ("d", "EX"), ("e", None)], "species string, status string")
    assert [(r.status, r.n) for r in ex.status_histogram(df).collect()] == [("CR", 1), ("LC", 2)]


def test_map_features(spark):
    df = spark.createDataFrame(
        [(1, "Sci a", "En", "", "Fr", "LC", datetime.date(2024, 1, 2), 3, "Here", "55.5", "12.0"),
         (2, "Sci b", None, None, None, None, None, None, "", "55.5", "12.0"), (3, "Sci c", None, None, None, None, None, None, None, "bad", "1")],
        "obs_id int, scientific_name string, common_name_en string, common_name_da string, common_name_fr string, status string, "
        "observed_on date, individual_count int, locality string, lat string, lon string")
    features = ex.map_features(df)
    full, bare = features.orderBy("obs_id").collect()
    assert full.popup == "<b>En</b><br>🇫🇷 Fr<br><i>Sci a</i><br>IUCN: LC<br>Date: 2024-01-02<br>Count: 3<br>📍 Here"
    assert (bare.popup, bare.status, bare.name) == ("<b>Sci b</b><br><i>Sci b</i>", "?", "Sci b")
    assert tuple(ex.map_totals(features).first()) == (2, 2)
    line = json.loads(ex.geojson_lines(features).first().value)
    assert line["type"] == "Feature" and line["geometry"]["coordinates"] == [12.0, 55.5]


def test_recent_sightings_take_any_number_of_days(spark):
    today = F.lit("2024-04-12").cast("date")
    assert ex.recent_sightings(sightings(spark), today, 99).count() == 2
