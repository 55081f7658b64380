"""Schemas of landed source files and of the triple table."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

# o_lang and o_datatype are '' when absent, so whole-triple joins use plain equality
TRIPLE = _fields(("s", _S), ("p", _S), ("o", _S), ("o_kind", _S), ("o_lang", _S), ("o_datatype", _S))
TRIPLE_COLUMNS = TRIPLE.fieldNames()

TAXONOMY_RECORD = _fields(
    ("speciesCode", _S), ("category", _S), ("sciName", _S), ("scientificName", _S), ("comName", _S),
    ("order", _S), ("familySciName", _S), ("familyComName", _S), ("taxonOrder", _D), ("seq", _L),
)

LOCALIZED_NAME_RECORD = _fields(("speciesCode", _S), ("category", _S), ("comName", _S))

OCCURRENCE_RECORD = _fields(
    ("key", _L), ("gbifID", _S), ("datasetKey", _S), ("basisOfRecord", _S), ("scientificName", _S),
    ("eventDate", _S), ("dateIdentified", _S), ("individualCount", _S), ("decimalLatitude", _D),
    ("decimalLongitude", _D), ("locality", _S), ("verbatimLocality", _S), ("recordedBy", _S),
    ("speciesKey", _L), ("taxonKey", _L), ("iucnRedListCategory", _S), ("year", T.IntegerType()), ("seq", _L),
)

OCCURRENCE_PAGE = _fields(("results", T.ArrayType(OCCURRENCE_RECORD)), ("endOfRecords", T.BooleanType()))

SIGHTING_RECORD = _fields(
    ("speciesCode", _S), ("comName", _S), ("sciName", _S), ("obsDt", _S), ("locName", _S),
    ("lat", _D), ("lng", _D), ("howMany", T.IntegerType()),
)

BOUND_VALUE = _fields(("type", _S), ("value", _S), ("datatype", _S))
BINDINGS = T.StructType([
    T.StructField("results", T.StructType([
        T.StructField("bindings", T.ArrayType(T.MapType(_S, BOUND_VALUE))),
    ])),
])

_TEXTS = T.MapType(_S, _S)
IUCN_LOOKUP = T.StructType([
    T.StructField("taxon", _fields(
        ("sis_id", _L), ("scientific_name", _S), ("genus_name", _S), ("species_name", _S))),
    T.StructField("assessments", T.ArrayType(_fields(
        ("year_published", _S), ("latest", T.BooleanType()), ("assessment_id", _L)))),
])
IUCN_ASSESSMENT = T.StructType([
    T.StructField("assessment_id", _L),
    T.StructField("red_list_category", _fields(("code", _S), ("description", _TEXTS))),
    T.StructField("population_trend", _fields(("code", _S), ("description", _TEXTS))),
    T.StructField("supplementary_info", _fields(("movement_patterns", _S), ("population_size", _S))),
    T.StructField("habitats", T.ArrayType(_fields(
        ("description", _TEXTS), ("suitability", _S), ("season", _S), ("majorImportance", _S)))),
    T.StructField("threats", T.ArrayType(_fields(
        ("description", _TEXTS), ("scope", _S), ("severity", _S), ("timing", _S)))),
    T.StructField("systems", T.ArrayType(_fields(("description", _TEXTS), ("code", _S)))),
])

RESULT_ITEM = _fields(
    ("thumbnail", _S), ("commonNameEn", _S), ("commonNameFr", _S), ("scientificName", _S))
