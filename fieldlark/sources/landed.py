"""Readers for landed source files (JSON Lines unless said otherwise).

Downloads are not done here; jobs read what a downloader has written. Records
carry ``seq``, their position in the download, where first or last wins matters.
A line that does not parse is left out, as a batch of bindings that does not parse is.
Every reader can be told to fail on one instead (``strict``), or to count what it reads and
leaves out while the job runs (``counts``, an Observation whose ``get`` has ``n_read`` and
``n_bad`` afterwards); ``reader_report`` counts without reading on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from fieldlark.model import types
from fieldlark.operators.enrichment import PICTURE_VARIABLES, TRAIT_VARIABLES, binding_columns
from fieldlark.operators.extracts import recent_sightings

CORRUPT = "_corrupt_record"

# fixed values: the observation dataset and the basis of record that are read by default
DATASET_KEY = "95db4db8-f762-11e1-a439-00145eb45e9a"
BASIS_OF_RECORD = "HUMAN_OBSERVATION"


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Records of *path* plus a ``_corrupt_record`` column for lines that do not parse."""
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(with_bad).json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=multi_line)


def _is_bad(records: DataFrame) -> Column:
    """Whether a record did not parse. The test also looks at a field of the data, because Spark refuses to read the
    column of corrupt lines alone, which is all that a count would need."""
    first = next(c for c in records.columns if c != CORRUPT)
    return F.coalesce(F.length(CORRUPT), F.lit(-1) - F.col(f"`{first}`").isNull().cast("int")) >= 0


def valid(records: DataFrame, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    """Records that parsed. With *strict* one that did not fails the job; *counts* counts both as they are read."""
    bad = _is_bad(records)
    if counts is not None:
        records = records.observe(counts, F.count(F.lit(1)).alias("n_read"), F.count_if(bad).alias("n_bad"))
    if strict:
        refused = F.raise_error(F.concat(F.lit("does not parse: "), F.substring(CORRUPT, 1, 200)))
        # in the data too: a filter that follows may drop the record before this one sees it
        first = next(f for f in records.schema.fields if f.name != CORRUPT)
        records = records.withColumn(first.name, F.when(bad, refused.cast(first.dataType)).otherwise(F.col(f"`{first.name}`")))
        bad = F.when(F.col(CORRUPT).isNotNull(), refused.cast("boolean")).otherwise(F.lit(False))
    return records.where(~bad).drop(CORRUPT)


def _json_counts(schema: T.StructType) -> T.StructType:
    """*schema* with the individual count as it stands in JSON, a number or a text."""
    return T.StructType([T.StructField(f.name, T.VariantType()) if f.name == "individualCount" else f for f in schema])


def _counts_as_text(records: DataFrame) -> DataFrame:
    """JSON numbers as the text of their whole part; texts stay, whatever they hold."""
    raw = F.col("individualCount")
    number = F.try_variant_get(raw, "$", "double").cast("bigint").cast("string")
    is_number = F.schema_of_variant(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return records.withColumn(
        "individualCount", F.when(is_number, number).otherwise(F.try_variant_get(raw, "$", "string")))


def input_report(records: DataFrame) -> DataFrame:
    """One row: records read, records set aside, and records that parse but hold no field."""
    good = F.col(CORRUPT).isNull()
    filled = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in records.columns if c != CORRUPT])
    return records.agg(
        F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_corrupt"),
        F.count_if(good & filled.isNull()).alias("n_empty"))


def read_taxonomy(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    return valid(read_json(spark, path, types.TAXONOMY_RECORD), strict, counts)


def read_localized_names(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    """Name records; the locale is the directory partition ``locale=..``."""
    return valid(read_json(spark, path, T.StructType([
        *types.LOCALIZED_NAME_RECORD.fields, T.StructField("locale", T.StringType())])), strict, counts)


def read_occurrences(
    spark: SparkSession, path: str, dataset_key: str | None = DATASET_KEY,
    basis: str | None = BASIS_OF_RECORD, years: tuple[int, int] | None = None,
    strict: bool = False, counts: Observation | None = None,
) -> DataFrame:
    """Occurrence records of one dataset and basis; a year range prunes ``year=..`` partitions."""
    rows = _counts_as_text(valid(read_json(spark, path, _json_counts(types.OCCURRENCE_RECORD)), strict, counts))
    if dataset_key is not None:
        rows = rows.where(F.col("datasetKey") == dataset_key)
    if basis is not None:
        rows = rows.where(F.col("basisOfRecord") == basis)
    if years is not None:
        rows = rows.where(F.col("year").between(*years))
    return rows


def read_occurrence_pages(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    """Records of saved result pages, one page per line."""
    schema = T.StructType([
        T.StructField("results", T.ArrayType(_json_counts(types.OCCURRENCE_RECORD))), types.OCCURRENCE_PAGE["endOfRecords"]])
    pages = valid(read_json(spark, path, schema), strict, counts)
    return _counts_as_text(pages.select(F.explode("results").alias("r")).select("r.*"))


def read_bindings(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    """Query results in SPARQL JSON, one file per batch, as rows (seq, b).

    ``seq`` is (file, position). A file that does not parse is skipped, and counted as one that is bad; the rest continue.
    """
    files = read_json(spark, path, types.BINDINGS, multi_line=True).withColumn("_file", F.col("_metadata.file_path"))
    rows = valid(files, strict, counts).select("_file", F.posexplode("results.bindings").alias("_pos", "b"))
    return rows.select(F.struct("_file", "_pos").alias("seq"), "b")


def read_trait_bindings(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    return binding_columns(read_bindings(spark, path, strict, counts), TRAIT_VARIABLES)


def read_picture_bindings(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    return binding_columns(read_bindings(spark, path, strict, counts), PICTURE_VARIABLES)


def read_iucn_lookups(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    """Name lookups as (name, assessments)."""
    return valid(read_json(spark, path, types.IUCN_LOOKUP), strict, counts).select(
        F.col("taxon.scientific_name").alias("name"), "assessments")


def read_iucn_assessments(
    spark: SparkSession, path: str, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    return valid(read_json(spark, path, types.IUCN_ASSESSMENT), strict, counts)


def read_sightings(
    spark: SparkSession, path: str, days: int | None = None, strict: bool = False, counts: Observation | None = None) -> DataFrame:
    """Live sightings, optionally only those of the last *days* days."""
    rows = valid(read_json(spark, path, types.SIGHTING_RECORD), strict, counts)
    return rows if days is None else recent_sightings(rows, F.current_date(), days)


# schema of each kind of landed file, and whether a file is one record
KINDS = {
    "taxonomy": (types.TAXONOMY_RECORD, False), "localized_names": (types.LOCALIZED_NAME_RECORD, False),
    "occurrences": (_json_counts(types.OCCURRENCE_RECORD), False), "occurrence_pages": (types.OCCURRENCE_PAGE, False),
    "bindings": (types.BINDINGS, True), "iucn_lookups": (types.IUCN_LOOKUP, False),
    "iucn_assessments": (types.IUCN_ASSESSMENT, False), "sightings": (types.SIGHTING_RECORD, False),
}


def reader_report(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per kind of file in *paths* (see KINDS): kind, n_valid, n_bad, n_empty and n_bad_files.

    Records are lines, or whole files of bindings. An empty record parses but holds no field.
    """
    reports = []
    for kind, path in paths.items():
        records = read_json(spark, path, *KINDS[kind]).withColumn("_file", F.col("_metadata.file_path"))
        data = [F.col(f"`{c}`").isNotNull() for c in records.columns if c not in (CORRUPT, "_file")]
        filled, bad = reduce(lambda a, b: a | b, data), _is_bad(records)
        reports.append(records.agg(
            F.lit(kind).alias("kind"), F.count_if(~bad).alias("n_valid"), F.count_if(bad).alias("n_bad"),
            F.count_if(~bad & ~filled).alias("n_empty"), F.count_distinct(F.when(bad, F.col("_file"))).alias("n_bad_files")))
    return reduce(lambda a, b: a.unionByName(b), reports)


def stream_sightings(spark: SparkSession, path: str) -> DataFrame:
    """Live sightings as files arrive in *path*; lines that do not parse are left out."""
    with_bad = T.StructType([*types.SIGHTING_RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    return valid(spark.readStream.schema(with_bad).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT))
