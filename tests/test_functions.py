import datetime
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldlark.functions import geo, migration, status, text
from tests.conftest import rows


def apply(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def plain_fold(s):
    special = {"ø": "o", "æ": "ae", "å": "a", "ß": "ss", "œ": "oe", "ð": "d", "þ": "th"}
    s = "".join(special.get(c, special.get(c.lower(), c)) if c.lower() in special else c for c in s)
    return "".join(c for c in unicodedata.normalize("NFD", s) if ord(c) < 128).lower()


NAMES = ["Mésange", "Rødhals", "Flagspætte", "Åkande", "Épervier", "straße", "Œdicnème", "Þórshani", "Ðoti",
         "Ñandú", "Łabędź", "ẞ", "日本", "áb", "", "Ǻ", "ﬁn", "K", "İstanbul"]


def test_full_fold_equals_the_rule(spark):
    generator = random.Random(7)
    noise = ["".join(chr(generator.randrange(0x20, 0x2000)) for _ in range(12)) for _ in range(300)]
    # fold case of dotless and dotted capital letters follows the platform's lower()
    names = [n for n in NAMES if n not in ("ẞ",)] + noise
    assert apply(spark, names, text.fold_full) == [plain_fold(n) for n in names]


def test_compat_fold_leaves_capital_accents(spark):
    assert apply(spark, ["Épervier", "Mésange", "Flagspætte", "Østers"], text.fold_compat) == [
        "épervier", "mesange", "flagspaette", "østers"]


@pytest.mark.parametrize("query, fold, hits", [
    ("mesange", "compat", ["Mésange"]), ("MÉSANGE", "compat", ["Mésange"]), ("epervier", "compat", []),
    ("epervier", "full", ["Épervier"]), ("épervier", "compat", ["Épervier"]), ("rodhals", "compat", ["Rødhals"]),
    ("flagspaette", "full", ["Flagspætte"]), ("akande", "full", ["Åkande"]), ('a"b', "full", []),
])
def test_name_matches(spark, query, fold, hits):
    df = spark.createDataFrame([(n,) for n in NAMES[:5]], "name string")
    assert rows(df.where(text.name_matches(F.col("name"), query, fold))) == hits


def test_missing_name_does_not_hide_a_match(spark):
    df = spark.createDataFrame([("Robin", None), (None, "Robin"), (None, None), ("x", None)], "a string, b string")
    assert df.where(text.any_name_matches([F.col("a"), F.col("b")], "robin")).count() == 2


def test_slugs(spark):
    assert apply(spark, ["European Robin", "White-tailed Eagle", "Great Crested Grebe", "  a  ", ""], text.dbpedia_slug) == [
        "European_robin", "White-tailed_eagle", "Great_crested_grebe", "a", ""]
    assert apply(spark, ["_a b-c.", "Æ", "--"], text.iri_slug) == ["a_b-c", "", "--"]
    assert apply(spark, ["Parus major (L., 1758)", "a-b"], text.name_slug) == ["Parus_major__L___1758", "a_b"]
    assert apply(spark, ["Parus  major\t(L.)", "Parus", " Parus major x"], text.binomial) == [
        "Parus major", "Parus", "Parus major"]
    assert apply(spark, ["http://a/b/c", "c"], text.last_segment) == ["c", "c"]


def test_number_text_is_the_shortest_form(spark):
    generator = random.Random(3)
    values = [0.0, -0.0, 1.0, 55.694, 1e-4, 5e-4, -0.0003, 9.9e-5, 1.5e-7, 1e7, 12345678.5, 1e15, 1e16, 1.25e20, -1e-10]
    values += [round(generator.uniform(-180, 180), generator.randrange(0, 7)) for _ in range(200)]
    values += [generator.uniform(-1e-3, 1e-3) for _ in range(50)]
    assert apply(spark, values, text.number_text, "double") == [repr(x) for x in values]


def test_status(spark):
    codes = ["CR", "NE", "EX", None, "xx"]
    assert apply(spark, codes, status.status_rank) == [0, 6, 999, 999, 999]
    assert apply(spark, codes, status.status_label) == [
        "Critically Endangered", "Not Evaluated", "Extinct", None, None]
    assert apply(spark, [" en ", "EX", "", None, "lc"], status.clean_status) == ["EN", None, None, None, "LC"]


@pytest.mark.parametrize("months, expected", [
    ([], "Unknown"), (list(range(1, 10)), "Resident"), ([6, 1], "PartialMigrant"), ([5], "SummerVisitor"),
    ([12], "WinterVisitor"), ([3, 4, 9], "PassageMigrant"), ([3, 4, 8, 9, 10, 11], "PassageMigrant"),
    ([1, 2, 3, 4, 8, 9, 10, 11], "WinterVisitor"),
])
def test_migration_class(spark, months, expected):
    df = spark.createDataFrame([(months,)], "m array<int>")
    mask = migration.months_mask(F.col("m"))
    row = df.select(migration.migration_class(mask).alias("c"), migration.mask_months(mask).alias("back")).first()
    assert row.c == expected and row.back == sorted(months)


def test_month_mask_aggregates(spark):
    dates = [datetime.date(2024, m, 1) for m in (1, 12, 1, 7)]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    assert df.agg(migration.mask_months(migration.month_mask(F.col("d")))).first()[0] == [1, 7, 12]


def test_likely_present(spark):
    df = spark.createDataFrame([(s, m) for s in ("Resident", "SummerVisitor", "WinterVisitor", "PassageMigrant", "?")
                                for m in range(1, 13)], "s string, m int")
    got = rows(df.where(migration.is_likely_present(F.col("s"), F.col("m"))).groupBy("s").agg(F.sum("m")))
    assert got == sorted([("Resident", 78), ("SummerVisitor", 39), ("WinterVisitor", 39), ("PassageMigrant", 31), ("?", 78)], key=repr)


def test_migration_label_passes_unknown_codes(spark):
    assert apply(spark, ["Resident", "odd", None], migration.migration_label) == ["🏠 Resident", "odd", None]


def brute_km(lat1, lon1, lat2, lon2):
    a, b = (tuple(math.radians(x) for x in p) for p in ((lat1, lon1), (lat2, lon2)))
    x = [(math.cos(p[0]) * math.cos(p[1]), math.cos(p[0]) * math.sin(p[1]), math.sin(p[0])) for p in (a, b)]
    return 6371.0 * math.acos(max(-1.0, min(1.0, sum(i * j for i, j in zip(*x)))))


@pytest.mark.parametrize("place", [(55.6918, 12.5559, 25.0), (0.0, 179.99, 50.0), (10.0, -179.95, 30.0), (89.9, 10.0, 40.0),
                                   (60.0, 5.0, 900.0), (-85.0, 0.0, 300.0)])
def test_box_never_loses_a_point_within_the_radius(spark, place):
    lat, lon, radius = place
    generator = random.Random(5)
    reach = 3 * radius / 111
    points = []
    for _ in range(3000):
        la = max(-90.0, min(90.0, lat + generator.uniform(-reach, reach)))
        lo = generator.uniform(-180, 180) if abs(lat) > 80 else (lon + generator.uniform(-reach * 3, reach * 3) + 180) % 360 - 180
        points.append((la, lo))
    df = spark.createDataFrame(points, "lat double, lon double")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), lat, lon)
    kept = df.where(geo.inside_box(F.col("lat"), F.col("lon"), lat, lon, radius)).where(km <= radius)
    assert kept.count() == sum(brute_km(lat, lon, *p) <= radius for p in points) > 0


def test_grid_key(spark):
    df = spark.createDataFrame([(55.694, -12.554), (-0.5, 3.0)], "lat double, lon double")
    assert rows(df.select(geo.grid_key(F.col("lat"), F.col("lon")))) == ["55p6940_N12p5540", "N0p5000_3p0000"]
