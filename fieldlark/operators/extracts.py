"""Tables behind maps, charts, the live view and the conversation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from fieldlark.functions import status, text
from fieldlark.model import vocab as v
from fieldlark.model.types import RESULT_ITEM
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators import closure
from fieldlark.operators.grouping import pick_first, top_per_key
from fieldlark.operators.inference import parent_edges
from fieldlark.operators.triples import exists, scan

# fixed values: limits of the conversation tools
RESULT_LIMIT = 25
LIVE_LIMIT = 40
THUMBNAIL_LIMIT = 4
HISTORY_LIMIT = 40
IDLE_SECONDS = 7200
NO_RESULTS = "No results found."


# -- taxonomy network -------------------------------------------------------

def network_species(
    species: DataFrame, observations: DataFrame, family_filter: str | None = None, order_filter: str | None = None,
) -> DataFrame:
    """Species with an observation, external ones included, after the optional filters."""
    kept = exists(species, observations.select("species"))
    if family_filter:
        kept = kept.where(text.contains_ignore_case(F.col("family"), family_filter))
    if order_filter:
        kept = kept.where(text.contains_ignore_case(F.col("order_name"), order_filter))
    return kept


def taxonomy_edges(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct (child, parent) edges on the way up from the kept species."""
    return closure.reachable_edges(edges, kept.select(F.col("species").alias("node")))


def taxonomy_nodes(
    kept: DataFrame, reached: DataFrame, triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Kept species and all their ancestors once, with label, status and group."""
    leaves = kept.select(
        F.col("species").alias("node"),
        F.coalesce(
            text.first_non_empty(F.col("common_name_da"), F.col("common_name_en"), F.col("scientific_name")),
            text.last_segment(F.col("species"))).alias("label"),
        "status", F.lit("species").alias("group"))
    above = reached.select(F.col("parent").alias("node")).distinct().join(
        leaves.select("node"), "node", "left_anti")
    facts = exists(
        triples.where(F.col("p").isin(v.TYPE, v.SCIENTIFIC_NAME)), above.withColumnRenamed("node", "s"))
    is_type = F.col("p") == v.TYPE
    described = facts.groupBy(F.col("s").alias("node")).agg(
        F.min(F.when(F.col("p") == v.SCIENTIFIC_NAME, F.col("o"))).alias("name"),
        F.max(is_type & (F.col("o") == vocab.term("Order"))).alias("is_order"),
        F.max(is_type & (F.col("o") == vocab.term("Family"))).alias("is_family"))
    ancestors = above.join(described, "node", "left").select(
        "node",
        F.coalesce(text.non_empty(F.col("name")), text.last_segment(F.col("node"))).alias("label"),
        F.lit(None).cast("string").alias("status"),
        F.when(F.col("is_order"), "order").when(F.col("is_family"), "family").otherwise("genus").alias("group"))
    return leaves.unionByName(ancestors)


def status_histogram(species: DataFrame) -> DataFrame:
    """Species per ranked status, most threatened first; other codes are left out."""
    return (
        species.where(F.col("status").isin(list(status.RANK)))
        .groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        .select("status", status.status_label(F.col("status")).alias("label"), "n")
        .orderBy(status.status_rank(F.col("status")))
    )


# -- map --------------------------------------------------------------------

def _display_name() -> Column:
    return text.first_non_empty(F.col("common_name_da"), F.col("common_name_en"), F.col("scientific_name"))


def map_features(extract: DataFrame) -> DataFrame:
    """Rows of a map extract that have usable coordinates, with popup text and status."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")

    def line(prefix: str, value: Column, suffix: str = "") -> Column:
        present = text.non_empty(value.cast("string"))
        return F.concat(F.lit(prefix), present, F.lit(suffix))

    sci = F.coalesce("scientific_name", F.lit("?"))
    name = F.coalesce(_display_name(), F.lit("?"))
    popup = F.concat_ws(
        "<br>", line("<b>", name, "</b>"), line("🇫🇷 ", F.col("common_name_fr")), line("<i>", sci, "</i>"),
        line("IUCN: ", F.col("status")), line("Date: ", F.col("observed_on")),
        line("Count: ", F.col("individual_count")), line("📍 ", F.col("locality")))
    return extract.where(lat.isNotNull() & lon.isNotNull()).select(
        "obs_id", "scientific_name", lon.alias("lon"), lat.alias("lat"), popup.alias("popup"),
        F.coalesce(text.non_empty(F.col("status")), F.lit("?")).alias("status"), name.alias("name"))


def map_totals(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("n_observations"), F.count_distinct("scientific_name").alias("n_species"))


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per line."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("popup", "status", "name").alias("properties"))
    return features.select(F.to_json(feature).alias("value"))


# -- live sightings ---------------------------------------------------------

def live_flag(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Expected species, each marked when its code has been reported lately."""
    codes = live.select(F.coalesce("speciesCode", F.lit("")).alias("_code")).distinct().withColumn("_live", F.lit(True))
    code = F.coalesce(expected["ebird_code"], F.lit(""))
    return (
        expected.join(codes, code == codes["_code"], "left")
        .withColumn("is_live", F.col("_live").isNotNull()).drop("_code", "_live")
    )


def clamp_days(days: int) -> int:
    """Days a web endpoint would accept; landed data has no such bounds."""
    return max(1, min(days, 30))


def recent_sightings(live: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Sightings of the last *days* days."""
    seen = F.substring("obsDt", 1, 10).try_cast("date")
    return live.where(seen.between(F.date_sub(as_of, days), as_of))


def live_sightings(live: DataFrame) -> DataFrame:
    """Sightings under their display names; a missing count is shown as X."""
    return live.select(
        F.coalesce("comName", F.lit("")).alias("species"), F.coalesce("sciName", F.lit("")).alias("sciName"),
        F.coalesce("obsDt", F.lit("")).alias("date"), F.coalesce("locName", F.lit("")).alias("location"),
        "lat", F.col("lng").alias("lon"), F.coalesce(F.col("howMany").cast("string"), F.lit("X")).alias("count"))


# -- conversation tools -----------------------------------------------------

def result_cap(rows: DataFrame, order: list[Column], limit: int = RESULT_LIMIT) -> DataFrame:
    """The first *limit* rows as JSON with their position, and how many were left out.

    Only the kept rows are numbered in one task; the total is a separate aggregate.
    """
    shown = rows.orderBy(*order).limit(limit)
    total = rows.agg(F.count(F.lit(1))).scalar()
    numbered = F.row_number().over(Window.orderBy(*order))
    return shown.select(
        numbered.alias("position"), F.to_json(F.struct(*rows.columns)).alias("row"),
        F.greatest(total - F.lit(limit), F.lit(0)).alias("left_out"))


def result_text(capped: DataFrame) -> DataFrame:
    """A capped result as one text: a JSON list and a closing note, or the text for no rows."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("position", "row"))), lambda r: r["row"])
    left_out = F.coalesce(F.max("left_out"), F.lit(0))
    note = F.when(
        left_out > 0, F.concat(F.lit("\n\n… and "), left_out.cast("string"), F.lit(" more results not shown.")))
    body = F.concat(F.lit("["), F.array_join(rows, ",\n"), F.lit("]"))
    return capped.agg(
        F.when(F.count(F.lit(1)) == 0, NO_RESULTS).otherwise(F.concat(body, F.coalesce(note, F.lit("")))).alias("text"))


def thumbnails(
    results: DataFrame, keys: list[str], seq: str, column: str = "result", limit: int = THUMBNAIL_LIMIT,
) -> DataFrame:
    """The first pictures named in JSON result lists, each address once per key.

    Text that is not a JSON list, and items without an http address, are passed over.
    """
    is_list = F.ltrim(column).startswith("[")
    items = F.when(is_list, F.from_json(column, T.ArrayType(RESULT_ITEM)))
    rows = results.select(*keys, seq, F.posexplode(items).alias("position", "item")).select(
        *keys, F.col("item.thumbnail").alias("url"), F.col(seq).alias("seq"), "position",
        F.coalesce(text.first_non_empty(
            F.col("item.commonNameEn"), F.col("item.commonNameFr"), F.col("item.scientificName")),
            F.lit("")).alias("name"))
    order = [F.col("seq"), F.col("position")]
    unique = pick_first(rows.where(F.col("url").startswith("http")), [*keys, "url"], order)
    return top_per_key(unique, keys, [*order, F.col("url")], limit, spread_on=["url"])


def history_trim(messages: DataFrame, key: str, turn: str, keep: int = HISTORY_LIMIT) -> DataFrame:
    """The first message and the last *keep* of every conversation; ``turn`` is unique within it."""
    last = top_per_key(messages, [key], [F.desc(turn)], keep, spread_on=[turn])
    first = pick_first(messages, [key], [F.col(turn)]).select(*messages.columns)
    return last.unionByName(first.join(last.select(key, turn), [key, turn], "left_anti"))


def expired_sessions(log: DataFrame, key: str, ts: str, now: Column, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Keys whose last activity is more than *idle_seconds* before *now*."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return (
        log.groupBy(key).agg(F.max(ts).alias("last_seen"))
        .where(idle > F.lit(idle_seconds * 1_000_000))
    )


def sessions(log: DataFrame, key: str, ts: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions (key, started, ended, n): a pause of *idle_seconds* or more starts a new one.

    Rows are first merged into slots one pause long. Rows of one slot are always in
    one session, so the window below sorts slots, whose number is bounded by the
    time covered, and not the rows of a busy key.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    pause = idle_seconds * 1_000_000
    slots = log.where(F.col(ts).isNotNull()).groupBy(key, F.floor(micros / F.lit(pause)).alias("slot")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min(micros).alias("lo"),
        F.max(micros).alias("hi"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy(key).orderBy("slot")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(in_order) >= pause, F.lit(True))
    numbered = slots.withColumn("starts", starts).withColumn(
        "session", F.sum(F.col("starts").cast("int")).over(in_order))
    return numbered.groupBy(key, "session").agg(
        F.min("first_ts").alias("started"), F.max("last_ts").alias("ended"), F.sum("n").alias("n"),
    ).drop("session")


def network_edges_of(triples: DataFrame, kept: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Edges for a graph held as triples."""
    return taxonomy_edges(kept, parent_edges(scan(triples, p=vocab.parent_taxon), vocab))
