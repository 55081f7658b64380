import json

from pyspark.sql import functions as F

from fieldlark.operators import extracts as ex
from fieldlark.sources import landed
from fieldlark.streaming import live
from tests.conftest import rows


def land(folder, *records):
    folder.mkdir(exist_ok=True)
    for i, r in enumerate(records):
        (folder / f"{i}.json").write_text(json.dumps(r))
    return str(folder)


def seen(code, when):
    return {"speciesCode": code, "obsDt": when, "howMany": 1}


def timed(stream):
    return stream.withColumn("ts", F.to_timestamp("obsDt"))


def test_windows_equal_the_batch_result_behind_the_watermark(spark, tmp_path):
    path = land(tmp_path / "in", seen("a", "2024-01-01 10:00:00"), seen("a", "2024-01-01 23:00:00"), seen("b", "2024-01-02 01:00:00"),
                seen("a", "2024-01-09 00:00:00"))
    counted = live.run_available(live.sightings_per_window(timed(landed.stream_sightings(spark, path)), "speciesCode", "ts"), "w")
    batch = timed(landed.read_sightings(spark, path)).groupBy(F.window("ts", "1 day"), "speciesCode").count()
    batch = batch.where("window.end < '2024-01-07'")
    assert rows(counted, "speciesCode", "n") == rows(batch, "speciesCode", "count") == [("a", 2), ("b", 1)]


def test_sessions_equal_the_batch_result(spark, tmp_path):
    path = land(tmp_path / "in", *[seen("a", f"2024-01-01 0{h}:00:00") for h in (0, 1, 4)], seen("b", "2024-01-01 02:00:00"),
                seen("z", "2024-01-03 00:00:00"))
    stream = live.run_available(live.session_stream(timed(landed.stream_sightings(spark, path)), "speciesCode", "ts"), "s")
    batch = ex.sessions(timed(landed.read_sightings(spark, path)).where("speciesCode <> 'z'"), "speciesCode", "ts")
    columns = ("speciesCode", "started", "ended", "n")
    assert rows(stream, *columns) == rows(batch, *columns) and batch.count() == 3


def test_flags_and_first_arrivals(spark, tmp_path):
    path = land(tmp_path / "in", seen("a", "2024-01-01 10:00:00"), seen("b", "2024-01-01 11:00:00"), seen("a", "2024-01-01 12:00:00"))
    stream = landed.stream_sightings(spark, path)
    expected = spark.createDataFrame([("a",), ("a",)], "code string")
    assert rows(live.run_available(live.flag_stream(stream, expected, "speciesCode", "code"), "f"), "speciesCode", "is_expected") == [
        ("a", True), ("a", True), ("b", False)]
    once = live.first_arrivals(timed(stream), ["speciesCode"], "ts")
    assert rows(live.run_available(once, "d"), "speciesCode") == ["a", "b"]
