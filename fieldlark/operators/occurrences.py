"""Occurrence records to observations, and their link to species."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from fieldlark.functions import geo, status, text
from fieldlark.model import vocab as v
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators.grouping import pick_first, top_per_key
from fieldlark.operators.joins import spread_join
from fieldlark.operators.triples import Fact, has_type, link, to_triples
from fieldlark.session import cut_lineage

# fixed values: limits of one yearly download
PAGE_SIZE = 300
YEAR_CAP = 9_900
YEARS_BACK = 30


def record_key() -> Column:
    """The record's own key as text, NULL when it has none (0 and '' count as none)."""
    number = F.when(F.col("key") != 0, F.col("key").cast("string"))
    return F.coalesce(number, text.non_empty(F.col("gbifID")))


def observation_key(name: str = "scientificName") -> Column:
    """Stable id: the record key, else a short digest of name (as delivered), date and place."""
    parts = [F.col(name), F.col("eventDate"), text.number_text(F.col("decimalLatitude")),
             text.number_text(F.col("decimalLongitude"))]
    shown = [F.coalesce(part, F.lit("None")) for part in parts]
    return F.coalesce(record_key(), F.substring(F.md5(F.concat(*shown)), 1, 12))


def observed_date() -> Column:
    """Event date, else date of identification; NULL unless it is a real ISO date."""
    raw = F.substring(text.first_non_empty(F.col("eventDate"), F.col("dateIdentified")), 1, 10)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))


def individual_count(column: Column, data_type: T.DataType) -> Column:
    """Whole number of individuals; numbers are truncated, text must be an integer."""
    if isinstance(data_type, T.StringType):
        cleaned = text.strip(column)
        return F.when(cleaned.rlike(r"^[+-]?\d+$"), cleaned.try_cast("bigint"))
    return column.try_cast("bigint")


def capped_newest_first(
    records: DataFrame, max_records: int | None = None, year_cap: int | None = None, current_year: int | None = None,
) -> DataFrame:
    """One row per key, newest years first; a year is cut at *year_cap* (``YEAR_CAP`` is that of the paged
    download), the whole at *max_records*. Without caps all keys are kept.

    Records without a key are left out. A key that occurs in several years counts
    for the newest. Order within a year is that of ``seq``.
    """
    rows = records.withColumn("_key", record_key()).where(F.col("_key").isNotNull())
    if current_year is not None:
        rows = rows.where(F.col("year").between(current_year - YEARS_BACK + 1, current_year))
    newest = F.coalesce(-F.col("year"), F.lit(2**31 - 1))
    unique = pick_first(rows, ["_key"], [newest, F.col("seq")])
    if year_cap is not None:
        unique = top_per_key(unique, ["year"], [F.col("seq").asc()], year_cap, spread_on=["_key"])
    newest_first = unique.orderBy(F.desc("year"), F.asc("seq"))
    return (newest_first if max_records is None else newest_first.limit(max_records)).drop("_key")


def resolve_species(records: DataFrame, index: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Add ``species`` (and ``is_minted``): matched by binomial, else minted from the full name.

    ``_raw_name`` keeps the name as it was delivered. A name that many records carry is
    split by adaptive execution when the index is too large to broadcast.
    """
    named = (
        records.withColumn("_raw_name", F.col("scientificName"))
        .withColumn("scientificName", text.strip(F.col("scientificName")))
        .where(F.col("scientificName") != "")
        .withColumn("_binomial", text.binomial(F.col("scientificName")))
    )
    lookup = index.select(F.col("scientific_name").alias("_binomial"), F.col("species").alias("_known"))
    minted = F.concat(F.lit(vocab.taxon("species/sci/")), text.name_slug(F.col("scientificName")))
    return (
        spread_join(named, lookup, "_binomial", "left")
        .withColumn("species", F.coalesce("_known", minted))
        .withColumn("is_minted", F.col("_known").isNull())
        .drop("_binomial", "_known")
    )


def worst_status(resolved: DataFrame) -> DataFrame:
    """Most threatened status per species; unknown codes and extinct ones do not count."""
    rank = status.lookup(status.clean_status(F.col("iucnRedListCategory")), status.RANK)
    return (
        resolved.select("species", rank.alias("rank")).where(F.col("rank").isNotNull())
        .groupBy("species").agg(F.min("rank").alias("rank"))
        .select("species", status.status_of_rank(F.col("rank")).alias("status"))
    )


def observations(resolved: DataFrame, vocab: Vocab = DEFAULT, *also: Column) -> DataFrame:
    """Typed observation facts, and *also* other columns. Coordinates stay on the observation; ``loc_id`` is only a
    grid key."""
    lat, lon = F.col("decimalLatitude"), F.col("decimalLongitude")
    placed = lat.isNotNull() & lon.isNotNull()
    count_type = resolved.schema["individualCount"].dataType
    return resolved.select(
        F.concat(F.lit(vocab.observation()), observation_key(
            "_raw_name" if "_raw_name" in resolved.columns else "scientificName")).alias("obs_id"),
        "species", "is_minted",
        F.col("scientificName").alias("scientific_name"),
        observed_date().alias("observed_on"),
        individual_count(F.col("individualCount"), count_type).alias("individual_count"),
        text.non_empty(F.col("recordedBy")).alias("recorded_by"),
        record_key().try_cast("bigint").alias("gbif_key"),
        F.when(placed, F.concat(F.lit(vocab.location()), geo.grid_key(lat, lon))).alias("loc_id"),
        F.when(placed, lat).alias("lat"), F.when(placed, lon).alias("lon"),
        F.when(placed, text.first_non_empty(F.col("locality"), F.col("verbatimLocality"))).alias("locality"),
        F.concat(F.lit(v.GBIF_SPECIES), gbif_species_key()).alias("same_as"), *also,
    )


def gbif_species_key() -> Column:
    """Species key of the record, else its taxon key; 0 counts as missing."""
    keys = [F.when(F.col(c) != 0, F.col(c).cast("string")) for c in ("speciesKey", "taxonKey")]
    return F.coalesce(*keys)


def _statements(facts: DataFrame, vocab: Vocab) -> list[tuple[DataFrame, list[Fact]]]:
    """Wide tables of species, places and observations, each with the triples its rows make."""
    obs, sp, loc = F.col("obs_id"), F.col("species"), F.col("loc_id")
    return [
        (facts.where("is_minted").select("species", "scientific_name"), [
            has_type(sp, vocab.term("Species")), Fact(sp, v.SCIENTIFIC_NAME, F.col("scientific_name"))]),
        (facts.select("species", "same_as"), [link(sp, v.SAME_AS, F.col("same_as"))]),
        (facts.where("loc_id is not null").select(
            "loc_id", text.number_text(F.col("lat")).alias("lat"), text.number_text(F.col("lon")).alias("lon"), "locality"), [
            has_type(loc, vocab.term("Location")), Fact(loc, vocab.term("latitude"), F.col("lat"), datatype=v.DECIMAL),
            Fact(loc, vocab.term("longitude"), F.col("lon"), datatype=v.DECIMAL),
            Fact(loc, vocab.term("locality"), F.col("locality"))]),
        (facts.select(
            "obs_id", "species", "scientific_name", "observed_on", "individual_count", "recorded_by", "gbif_key", "loc_id"), [
            has_type(obs, vocab.term("Observation")), Fact(obs, v.SCIENTIFIC_NAME, F.col("scientific_name")),
            Fact(obs, vocab.term("observedOn"), F.col("observed_on"), datatype=v.DATE),
            Fact(obs, vocab.term("individualCount"), F.col("individual_count"), datatype=v.INTEGER),
            Fact(obs, vocab.term("recordedBy"), F.col("recorded_by")),
            Fact(obs, vocab.term("gbifKey"), F.col("gbif_key"), datatype=v.INTEGER),
            link(obs, vocab.term("observedAt"), loc), link(sp, vocab.has_observation, obs)]),
    ]


def occurrence_triples(records: DataFrame, index: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Occurrence records to distinct triples: observations, places, species links and worst status.

    The records are resolved once and written as wide rows. Duplicates go while rows are wide: species and places
    are few, and an observation makes its triples from one row, unless its id stands in several different ones.
    Only the triples of those observations, and of the few places and species, are made distinct one by one.
    """
    resolved = resolve_species(records, index, vocab)
    rank = status.lookup(status.clean_status(F.col("iucnRedListCategory")), status.RANK)
    facts = cut_lineage(observations(resolved, vocab, rank.alias("rank")), "observations")
    *few, (seen, made) = _statements(facts, vocab)
    alone = F.count("*").over(Window.partitionBy("obs_id")) == 1
    seen = cut_lineage(seen.distinct().withColumn("alone", alone), "observations")
    repeated = [to_triples(rows.distinct(), wanted).distinct() for rows, wanted in few]
    repeated.append(to_triples(seen.where("not alone"), made).distinct())
    ranked = facts.where("rank is not null").groupBy("species").agg(F.min("rank").alias("rank"))
    statuses = to_triples(ranked, [Fact(
        F.col("species"), vocab.term("conservationStatus"), status.status_of_rank(F.col("rank")))])
    return reduce(lambda a, b: a.unionByName(b), [to_triples(seen.where("alone"), made), *repeated, statuses])


def locations(facts: DataFrame) -> DataFrame:
    """One row per grid key; where points share a key the earliest observation id decides."""
    rows = facts.where(F.col("loc_id").isNotNull()).select("loc_id", "lat", "lon", "locality", "obs_id")
    return pick_first(rows, ["loc_id"], [F.col("obs_id")]).drop("obs_id")
