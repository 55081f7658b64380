"""The query catalogue over typed tables.

``species``       one row per species: species, scientific_name, common_name_en/da/fr,
                  ebird_code, family, order_name, thumbnail, range_map, mass_grams,
                  wingspan_mm, status, migration_status
``observations``  one row per sighting: obs_id, species, observed_on,
                  individual_count, locality, lat, lon
``habitats``      (species, habitat), ``months`` (species, month)

The species side of a join is broadcast when its size is within the session's
threshold; beyond it adaptive execution splits a species that holds many observations. Sorts end in a unique key, so that rows that are equal in the leading
keys still spread over many range partitions. Results are sets because the inputs are
(one row per species), so no query pays for a DISTINCT over wide rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlark.functions import curve, geo, status, text
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.operators.grouping import newest_key, pick_first
from fieldlark.operators.joins import spread_join
from fieldlark.operators.trigrams import Found
from fieldlark.operators.triples import exists, is_canonical, merge_records
from fieldlark.session import small_table

# fixed values: usual result limits, for callers that show results
NAME_LIMIT = 50
RECENT_LIMIT = 100

NAMES = ["scientific_name", "common_name_en", "common_name_da", "common_name_fr"]
MAP_NAMES = NAMES[:3]  # the map searches these
SIGHTING = ["obs_id", "observed_on", "individual_count", "locality", "lat", "lon"]


def _canonical(df: DataFrame, vocab: Vocab) -> DataFrame:
    return df.where(is_canonical(F.col("species"), vocab))


def _named(species: DataFrame) -> DataFrame:
    """Species that have a scientific name; others are in no list."""
    return species.where(F.col("scientific_name").isNotNull())


def name_table(names: DataFrame) -> DataFrame:
    """(species, kind, name) rows with the forms that searches compare: lower case and both folds."""
    return names.select("species", "kind", "name", *text.forms(F.col("name")))


def _matching(
    species: DataFrame, name: str, fold: str, names: DataFrame | None, found: Found | None, kinds: list[str] = NAMES,
) -> DataFrame:
    """Species with *name* in one of their names of these kinds; *found* holds them where an index has been asked."""
    if found is not None:
        return found.only(species)
    if names is None:
        return species.where(text.any_name_matches([F.col(c) for c in kinds], name, fold))
    if kinds != NAMES:
        names = names.where(F.col("kind").isin(kinds))
    hit = F.col("lower").contains(F.lower(F.lit(name))) | F.col(f"folded_{fold}").contains(text.fold_full(F.lit(name)))
    return exists(species, names.where(hit).select("species"))


def find_species_by_name(
    species: DataFrame, habitats: DataFrame, name: str, fold: str = "compat", limit: int | None = None,
    names: DataFrame | None = None, found: Found | None = None,
) -> DataFrame:
    """Species with *name* in their scientific, English, Danish or French name.

    One row per species and habitat; a limit (``NAME_LIMIT`` is the usual one) counts
    those rows. ``fold='compat'`` strips lower-case accents from stored names only,
    ``'full'`` all accents. Where *names* holds folded names (see ``name_table``), they
    are searched instead, so every name of a species counts and none is folded again;
    *found* is what an index found (see ``trigrams``), and nothing is searched.
    """
    columns = [
        "species", *NAMES, "ebird_code", "thumbnail", "range_map", "mass_grams", "wingspan_mm",
        "habitat", "status", "migration_status"]
    rows = (
        _named(_matching(species, name, fold, names, found)).join(habitats.select("species", "habitat").distinct(), "species", "left")
        .select(*columns)
        .orderBy("scientific_name", "species", "habitat")
    )
    return rows if limit is None else rows.limit(limit)


def list_observed_species(species: DataFrame, observations: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Canonical species with at least one observation."""
    return (
        exists(_named(_canonical(species, vocab)), observations.select("species"))
        .select("species", *NAMES).orderBy("scientific_name", "species")
    )


def species_by_family(species: DataFrame, family: str) -> DataFrame:
    return (
        _named(species).where(text.contains_ignore_case(F.col("family"), family))
        .select("species", "scientific_name", "common_name_en", "common_name_da", "ebird_code", "thumbnail")
        .orderBy("scientific_name", "species")
    )


def species_by_order(species: DataFrame, order: str) -> DataFrame:
    return (
        _named(species).where(text.contains_ignore_case(F.col("order_name"), order))
        .select("species", "scientific_name", "common_name_en", "family")
        .orderBy("family", "scientific_name", "species")
    )


def recent_observations(
    species: DataFrame, observations: DataFrame, name: str | None = None, fold: str = "compat",
    limit: int | None = None, vocab: Vocab = DEFAULT, names: DataFrame | None = None, found: Found | None = None,
) -> DataFrame:
    """The newest dated observations, of all species or of those with *name* in a name.

    The fact table is cut to *limit* rows (``RECENT_LIMIT`` is the usual number) before
    names are attached. *names* and *found* as in ``find_species_by_name``.
    """
    wanted = _canonical(species, vocab)
    if name:
        wanted = _matching(_named(wanted), name, fold, names, found)
    newest = (
        exists(_canonical(observations, vocab).where(F.col("observed_on").isNotNull()), wanted.select("species"))
        .select("species", *SIGHTING)
        .orderBy(F.desc("observed_on"), F.asc("obs_id"))
    )
    if limit is not None:
        newest = newest.limit(limit)
    return merge_records(_named(species).select("species", *NAMES), newest, "species")


def nearby_watch(
    species: DataFrame, observations: DataFrame, lat: float = geo.DEFAULT_LAT, lon: float = geo.DEFAULT_LON,
    radius_km: float = geo.DEFAULT_RADIUS_KM, vocab: Vocab = DEFAULT,
) -> DataFrame:
    """Latest sighting of every species within *radius_km*, most threatened first.

    Observations stored along the curve (column ``cell``) are also cut to the ranges of it that hold the circle.
    """
    placed = _canonical(observations, vocab)
    if "cell" in observations.columns:
        placed = placed.where(curve.near(F.col("cell"), lat, lon, radius_km))
    near = (
        placed.select("species", *SIGHTING)
        .where(geo.inside_box(F.col("lat"), F.col("lon"), lat, lon, radius_km))
        .where(geo.haversine_km(F.col("lat"), F.col("lon"), lat, lon) <= radius_km)
    )
    latest = pick_first(near, ["species"], [newest_key(F.col("observed_on")), F.col("obs_id")])
    info = species.select("species", *NAMES, "status")
    return latest.join(info, "species", "inner").withColumn("rank", status.status_rank(F.col("status"))).orderBy(
        "rank", "scientific_name", "species")


def threatened_count(watch: DataFrame) -> DataFrame:
    """Number of threatened and near-threatened species in a nearby result."""
    return watch.where(status.is_threatened(F.col("status"))).agg(F.count(F.lit(1)).alias("n"))


def currently_present(
    species: DataFrame, months: DataFrame, month: int | None = None, vocab: Vocab = DEFAULT) -> DataFrame:
    """Canonical species typically present in *month*, by default the current one."""
    wanted = F.month(F.current_date()) if month is None else F.lit(month)
    present = months.where(F.col("month") == wanted)
    return (
        exists(_named(_canonical(species, vocab)), present.select("species"))
        .select("species", *NAMES, "ebird_code", "status", "migration_status")
        .orderBy("migration_status", "scientific_name", "species")
    )


def observations_for_map(
    species: DataFrame, observations: DataFrame, species_filter: str | None = None,
    family_filter: str | None = None, order_filter: str | None = None, vocab: Vocab = DEFAULT, ordered: bool = True,
    names: DataFrame | None = None, found: Found | None = None,
) -> DataFrame:
    """Every placed observation of canonical species with names and status, filters optional.

    Without *ordered* nothing is sorted, for outputs that have no order.
    """
    wanted = _named(_canonical(species, vocab))
    if family_filter:
        wanted = wanted.where(text.contains_ignore_case(F.col("family"), family_filter))
    if order_filter:
        wanted = wanted.where(text.contains_ignore_case(F.col("order_name"), order_filter))
    if species_filter:
        wanted = _matching(wanted, species_filter, "full", names, found, MAP_NAMES)
    placed = observations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    rows = spread_join(
        _canonical(placed, vocab).select("species", *SIGHTING), wanted.select("species", *NAMES, "status"), "species")
    return rows.orderBy(F.asc("scientific_name"), F.desc("observed_on"), F.asc("obs_id")) if ordered else rows


def taxonomy_summary(typed: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Instances per class from type rows (s, class): all five classes, zero where there is none.

    One aggregate over the types; classes without instances are filled in from the
    five labels, whose number is fixed.
    """
    # fixed values: labels of the summary
    labels = [("orders", "Order"), ("families", "Family"), ("genera", "Genus"),
              ("species", "Species"), ("observations", "Observation")]
    wanted = small_table(
        typed.sparkSession, [(label, vocab.term(cls)) for label, cls in labels], "label string, class string")
    counts = (
        typed.where(F.col("class").isin([vocab.term(cls) for _, cls in labels]))
        .groupBy("class").agg(F.count_distinct("s").alias("n"))
    )
    return F.broadcast(wanted).join(counts, "class", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
