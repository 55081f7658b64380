"""Keys along the curve, and circles as ranges of them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldlark.functions import curve, geo
from fieldlark.operators.queries import nearby_watch
from tests.test_plans import plan

CIRCLES = [(55.69, 12.55, 2.0), (0.0, 0.0, 100.0), (89.9, 10.0, 50.0), (-89.99, -170.0, 5.0), (10.0, 179.99, 30.0),
           (-20.0, -179.9, 300.0), (60.0, 20.0, 20000.0), (45.0, 45.0, 0.0)]


def key(lat, lon):
    y, x = curve._number(lat, -90.0, 180.0), curve._number(lon, -180.0, 360.0)
    return sum((y >> i & 1) << 2 * i + 1 | (x >> i & 1) << 2 * i for i in range(curve.BITS))


def points(n):
    draw = random.Random(4)
    around = [(lat + draw.uniform(-1, 1), lon + draw.uniform(-2, 2)) for lat, lon, _ in CIRCLES for _ in range(n)]
    wrapped = [(max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180) for lat, lon in around]
    return wrapped + [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(n)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]


def test_keys(spark):
    rows = [*points(30), (None, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 1.0), (95.0, -200.0)]
    got = [r.k for r in spark.createDataFrame(rows, "lat double, lon double").select(curve.z_key(F.col("lat"), F.col("lon")).alias("k")).collect()]
    assert got[:-5] == [key(*p) for p in rows[:-5]]
    assert got[-5:] == [None, None, None, key(90.0, 1.0), key(90.0, -180.0)]


@pytest.mark.parametrize("lat, lon, radius", CIRCLES)
def test_a_circle_lies_in_few_ranges(spark, lat, lon, radius):
    ranges = curve.ranges_of(curve.boxes_around(lat, lon, radius))
    assert 0 < len(ranges) <= curve.MOST_RANGES and all(a <= b for a, b in ranges) and ranges == sorted(ranges)
    df = spark.createDataFrame(points(300), "lat double, lon double")
    inside = df.where(geo.haversine_km(F.col("lat"), F.col("lon"), lat, lon) <= radius)
    cell = curve.z_key(F.col("lat"), F.col("lon"))
    assert inside.where(~curve.near(cell, lat, lon, radius)).isEmpty()


def test_ranges_are_tight():
    """Four and more tiles for a box, so what is covered is a small multiple of the box."""
    for lat, lon, radius in CIRCLES[:2]:
        box = curve.boxes_around(lat, lon, radius)
        share = sum((b.north - b.south) / 180 * (b.east - b.west) / 360 for b in box)
        covered = sum(b - a + 1 for a, b in curve.ranges_of(box)) / 4 ** curve.BITS
        assert covered < 4 * share


def test_a_search_reads_few_rows_of_a_stored_table(spark, tmp_path):
    rows = spark.range(0, 200_000).select(
        F.concat(F.lit("o"), "id").alias("obs_id"), F.lit("https://example.org/fieldlark/taxon/species/a").alias("species"),
        F.lit("2024-01-01").cast("date").alias("observed_on"), F.lit(1).cast("long").alias("individual_count"), F.lit("x").alias("locality"),
        (F.pmod(F.xxhash64("id"), F.lit(180_000)) / 1000 - 90).alias("lat"), (F.pmod(F.xxhash64("id", "id"), F.lit(360_000)) / 1000 - 180).alias("lon"))
    rows.withColumn("cell", curve.z_key(F.col("lat"), F.col("lon"))).repartitionByRange(20, "cell").sortWithinPartitions("cell").write.option(
        "parquet.block.size", str(64 << 10)).parquet(str(tmp_path / "obs"))
    stored = spark.read.parquet(str(tmp_path / "obs"))
    names = "scientific_name string, common_name_en string, common_name_da string, common_name_fr string"
    species = spark.createDataFrame([("https://example.org/fieldlark/taxon/species/a", "A b", None, None, None, "LC")], f"species string, {names}, status string")
    asked = nearby_watch(species, stored, 55.0, 12.0, 100.0)
    plain = nearby_watch(species, stored.drop("cell"), 55.0, 12.0, 100.0)
    assert asked.collect() == plain.collect() and asked.count() == 1
    text = plan(nearby_watch(species, stored, 55.0, 12.0, 100.0))
    pushed = next(x for x in re.findall(r"PushedFilters: \[(.*?)\]\n", text) if "cell" in x)
    assert "GreaterThanOrEqual(cell" in pushed and "LessThanOrEqual(cell" in pushed
    # what the filters leave of the files, by their least and greatest keys
    files = stored.groupBy(F.col("_metadata.file_path")).agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    ranges = curve.ranges_of(curve.boxes_around(55.0, 12.0, 100.0))
    opened = sum(any(a <= r.high and b >= r.low for a, b in ranges) for r in files.collect())
    assert opened <= 4 and files.count() >= 15
