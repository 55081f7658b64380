"""Streaming operators, run over everything available and compared with the batch result."""

from pyspark.sql import functions as F

from checks.q_extract import SESSIONS
from checks.registry import query
from fieldlark.session import scratch_path
from fieldlark.streaming import batches, live


def events(t, *columns):
    """The events table as a stream, event time as TIMESTAMP."""
    schema = t.given("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)


def as_local(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_windows", """
    with w as (select user_id, date_trunc('day', ts) as window_start, count(*) as n from {events} group by all)
    select user_id, window_start, window_start + interval 1 day as window_end, n from w
    where window_start + interval 1 day <= (select max(ts) from {events}) - interval 2 day""")
def _(t):
    counts = live.sightings_per_window(events(t, "user_id", "ts"), "user_id", "ts")
    return as_local(live.run_available(counts, "windows"), "window_start", "window_end")


@query("stream_sessions", f"""
    select * from ({SESSIONS}) s
    where ended + interval 7200 second <= date_trunc('millisecond', (select max(ts) from {{events}})) - interval 2 hour""")
def _(t):
    closed = live.session_stream(events(t, "user_id", "ts"), "user_id", "ts")
    return as_local(live.run_available(closed, "sessions"), "started", "ended")


# slots that the first stream has closed, and what they say of its end to the second
SLOTS = """slot as (select user_id, floor(epoch_us(ts) / 7200000000) as k, min(ts) as lo from {events} where ts is not null group by all),
    closed as (select * from slot where make_timestamp(cast((k + 1) * 7200000000 as bigint))
      <= date_trunc('millisecond', (select max(ts) from {events})) - interval 2 hour)"""


@query("stream_sessions_of_slots", f"""
    with {SLOTS} select * from ({SESSIONS}) s
    where ended + interval 7200 second <= date_trunc('millisecond', (select max(lo) from closed)) - interval 7200 second""")
def _(t):
    """Rows are combined to slots before anything is sorted per user."""
    return as_local(batches.run_sessions(events(t, "user_id", "ts"), "user_id", "ts"), "started", "ended")


@query("stream_flags", """
    select event_id, user_id, 'c'||user_id in (select ebird_code from $species where status = 'LC') as is_expected
    from {events}""")
def _(t):
    rows = events(t, "event_id", "user_id").withColumn("code", F.concat(F.lit("c"), "user_id"))
    expected = t.species.where("status = 'LC'")
    flagged = live.flag_stream(rows, expected, "code", "ebird_code").drop("code")
    return live.run_available(flagged, "flags")


@query("stream_flags_by_version", """
    select event_id, 'c'||user_id in (select ebird_code from $species where status = 'LC') as is_expected, cast(2 as bigint) as version
    from {events}""")
def _(t):
    """The second version of the table counts, the first flags nothing."""
    folder = scratch_path(t.spark, "flags")
    batches.publish_expected(t.species.where("false").select(F.col("ebird_code").alias("code")), f"{folder}/codes", 1)
    batches.publish_expected(t.species.where("status = 'LC'").select(F.col("ebird_code").alias("code")), f"{folder}/codes", 2)
    rows = events(t, "event_id", "user_id").withColumn("code", F.concat(F.lit("c"), "user_id"))
    batches.flags_to(rows, f"{folder}/out", f"{folder}/state", "code", f"{folder}/codes").awaitTermination()
    return batches.read_flags(t.spark, rows.schema, f"{folder}/out").select("event_id", "is_expected", "version")


@query("stream_first_arrivals", "select distinct user_id, event_type from {events}")
def _(t):
    rows = live.first_arrivals(events(t, "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    return live.run_available(rows.select("user_id", "event_type"), "arrivals")


@query("stream_arrivals_by_period", """
    select event_type, period, min(at_time) as ts
    from (select event_type, cast(floor(epoch_us(ts) / 604800000000) as bigint) as period, ts as at_time from {events}) x
    where period is not null group by event_type, period""")
def _(t):
    """Few keys with many events each: one row per key and week."""
    folder = scratch_path(t.spark, "arrivals")
    rows = events(t, "event_type", "ts", "event_id")
    batches.first_arrivals_to(rows, f"{folder}/out", f"{folder}/state", ["event_type"], "ts", 7 * 86400).awaitTermination()
    return as_local(batches.read_arrivals(t.spark, rows.schema, f"{folder}/out"), "ts").drop("event_id")
