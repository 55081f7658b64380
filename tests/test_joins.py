"""Spread joins must equal plain joins, and hot keys must be split."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import joins
from tests.conftest import rows


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def sides(spark):
    generator = random.Random(4)
    keys = ["hot"] * 700 + [f"k{generator.randrange(900)}" for _ in range(1400)] + [None] * 5
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    right = spark.createDataFrame(
        [("hot", "a"), ("hot", "b")] + [(f"k{n}", f"v{n}") for n in range(0, 900, 2)] + [(None, "z")], "k string, v string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_plain_join(spark, no_broadcast, how):
    left, right = sides(spark)
    spread = joins.spread_join(left, right, "k", how)
    plain = left.join(right, "k", how)
    assert spread.columns == plain.columns
    assert rows(spread) == rows(plain)


def tasks_of(df, column="k"):
    """Rows per partition after the shuffle of a join, without adaptive execution."""
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_null_keys_are_spread(spark, no_broadcast):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in settings}
    left = spark.range(1000).select(F.when(F.col("id") % 10 < 3, F.col("id")).alias("k"), "id")
    right = spark.range(0, 1000, 2).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        for how in ("left", "left_anti"):
            assert max(tasks_of(joins.spread_join(left, right, "k", how))) < 100 < max(tasks_of(left.join(right, "k", how)))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


SKEW = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "20"}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", ["left", "right"])
def test_hot_key_is_split_also_beside_an_aggregate(spark, no_broadcast, hot):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    many = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"), F.col("id").alias("x"))
    few = spark.range(0, 5000, 1, 8).select(F.col("id").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    try:
        for k, x in SKEW.items():
            spark.conf.set(k, x)
        left, right = (many, few) if hot == "left" else (few, many)
        joined = joins.spread_join(left, right, "k")
        assert "SortMergeJoin(skew=true)" in executed(joined)
        assert joined.count() == left.join(right, "k").count()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_reads_each_side_once(spark, no_broadcast, tmp_path):
    left, right = sides(spark)
    for name, df in (("left", left), ("right", right)):
        df.write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert executed(joins.spread_join(left, right, "k", how)).split("== Initial")[0].count("Scan parquet") == 2


@pytest.mark.parametrize("sent", [0, 1 << 16])
@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_written_table_is_sent_by_its_rows(spark, monkeypatch, how, sent):
    """A table of many rows is not broadcast, however small its files are; a filter of bounded size is."""
    monkeypatch.setattr(joins, "SENT_ROWS", sent)
    monkeypatch.setattr(joins, "FILTER_WORDS", 2)  # nearly full, so that rows pass that do not match
    left, right = sides(spark)
    joined = joins.join_written(left, right.where("k <> 'hot' or v = 'a'"), "k", how)
    assert rows(joined.select("k", "i")) == rows(left.join(right.where("k <> 'hot' or v = 'a'"), "k", how).select("k", "i"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (sent == 0)


def test_the_filter_grows_with_the_keys(spark):
    """Few rows pass that match nothing, also beside millions of keys; it was one bit a key in a filter of one size."""
    keys, others = spark.range(3_000_000), spark.range(3_000_000, 3_100_000)
    assert joins.may_match(others, keys, "id").count() < 5_000
    assert joins.may_match(spark.range(0, 3_000_000, 1000), keys, "id").count() == 3000
    assert [joins.filter_words(n) for n in (0, 1, 4, 65_537, 8_000_000, 10**9)] == [1, 1, 1, 1 << 14, 1 << 21, 1 << 21]


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_nothing_is_joined_with_no_rows(spark, how):
    left, right = sides(spark)
    joined = joins.join_written(left, right.where("k = 'none'"), "k", how)
    assert rows(joined) == rows(left.join(right.where("k = 'none'"), "k", how))
    assert "Join" not in executed(joined).split("Initial Plan")[0]
