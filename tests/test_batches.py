"""Streams that keep what they know in files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fieldlark.operators import extracts as ex
from fieldlark.streaming import batches
from tests.conftest import rows

SCHEMA = "key string, kind string, ts timestamp, n long"


def land(spark, folder, events):
    """More files of a stream."""
    spark.createDataFrame(events, "key string, kind string, at string, n long").select(
        "key", "kind", F.col("at").cast("timestamp").alias("ts"), "n").coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def run(query):
    query.awaitTermination()


def test_first_arrivals_over_batches_equal_the_batch_result(spark, tmp_path):
    draw = random.Random(1)
    every = []
    for step in range(3):
        events = [("hot" if draw.random() < 0.4 else draw.choice(["a", "b", None]), draw.choice("xy"),
                   f"2024-01-{draw.randrange(1, 25):02d} 10:00:00" if draw.random() < 0.95 else None, i) for i in range(60)]
        land(spark, tmp_path / "in", events)
        every += events
        run(batches.first_arrivals_to(stream(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ["key", "kind"], "ts", 10 * 86400))
    got = batches.read_arrivals(spark, stream(spark, tmp_path / "in").schema, str(tmp_path / "out"))
    periods = {(k, kind, (int(at[8:10]) - 1 + 19723) // 10) for k, kind, at, _ in every if at}
    assert rows(got, "key", "kind", "period") == sorted(periods, key=repr)


def test_a_batch_that_is_run_again_leaves_nothing_twice(spark, tmp_path):
    land(spark, tmp_path / "in", [("a", "x", "2024-01-01 00:00:00", 1), ("b", "x", "2024-01-01 00:00:00", 2)])
    batch = spark.read.parquet(str(tmp_path / "in"))
    for number in (0, 0, 1, 1):  # as after a failure behind the write and before the commit
        batches.keep_first_arrivals(batch, number, str(tmp_path / "out"), ["key"], "ts", 86400)
    assert rows(batches.read_arrivals(spark, batch.schema, str(tmp_path / "out")), "key", "n") == [("a", 1), ("b", 2)]


def test_a_restart_in_the_middle_of_a_batch(spark, tmp_path, monkeypatch):
    land(spark, tmp_path / "in", [("a", "x", "2024-01-01 00:00:00", 1)])
    source = lambda: stream(spark, tmp_path / "in")
    start = lambda: batches.first_arrivals_to(source(), str(tmp_path / "out"), str(tmp_path / "state"), ["key"], "ts", 86400)
    run(start())
    land(spark, tmp_path / "in", [("a", "x", "2024-01-01 01:00:00", 2), ("b", "x", "2024-01-01 02:00:00", 3)])
    write = batches._replace_batch

    def fails(*args):
        write(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(batches, "_replace_batch", fails)
    query = start()
    try:
        query.awaitTermination()
        raise AssertionError("the batch should have failed")
    except Exception as error:
        assert "lost" in str(error)
    monkeypatch.setattr(batches, "_replace_batch", write)
    run(start())
    assert rows(batches.read_arrivals(spark, source().schema, str(tmp_path / "out")), "key", "n") == [("a", 1), ("b", 3)]


def test_a_code_added_between_two_batches_flags_the_second_only(spark, tmp_path):
    codes, out = str(tmp_path / "codes"), str(tmp_path / "out")
    publish = lambda names, version: batches.publish_expected(spark.createDataFrame([(x,) for x in names], "code string"), codes, version)
    publish(["a", "a", None], 1)
    event = ("a", "x", "2024-01-01 00:00:00", 1), ("b", "x", None, 2), (None, "x", None, 3)
    go = lambda: run(batches.flags_to(stream(spark, tmp_path / "in"), out, str(tmp_path / "state"), "key", codes))
    land(spark, tmp_path / "in", event)
    go()
    publish(["a", "b"], 2)
    land(spark, tmp_path / "in", event)
    go()
    got = batches.read_flags(spark, stream(spark, tmp_path / "in").schema, out)
    assert rows(got, "key", "is_expected", "version") == sorted([
        ("a", True, 1), ("b", False, 1), (None, False, 1), ("a", True, 2), ("b", True, 2), (None, False, 2)], key=repr)


def test_sessions_of_a_hot_key_equal_the_batch_result(spark, tmp_path):
    draw = random.Random(3)
    events = [("hot" if draw.random() < 0.4 else draw.choice("abc"), "x", draw.randrange(0, 40 * 86400), i) for i in range(400)]
    bursts = [("hot", "x", 5 * 86400 + j * 7199, j) for j in range(12)] + [("hot", "x", 6 * 86400 + j * 7200, j) for j in range(5)]
    land(spark, tmp_path / "in", [(k, kind, str(later(at)), n) for k, kind, at, n in events + bursts + [("end", "x", 60 * 86400, 0), ("end", "x", 70 * 86400, 0), ("end", "x", 80 * 86400, 0)]])
    closed = batches.run_sessions(stream(spark, tmp_path / "in"), "key", "ts")
    whole = ex.sessions(spark.read.parquet(str(tmp_path / "in")), "key", "ts").where("key <> 'end'")
    columns = ("key", "started", "ended", "n")
    assert rows(closed.where("key <> 'end'"), *columns) == rows(whole, *columns)


def later(seconds):
    import datetime as dt
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
