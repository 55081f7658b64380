"""Graph files: parquet partitioned by predicate, and N-Triples text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlark.model import vocab as v
from fieldlark.model.types import TRIPLE, TRIPLE_COLUMNS
from fieldlark.operators.grouping import distinct_rows
from fieldlark.session import using

_NODE = r"(<[^>]*+>|_:\S+)"
# possessive, and without a group per character: a literal may be of any length
_LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*+)>)?'
LINE = rf"^\s*+{_NODE}\s*+<([^>]*+)>\s*+(?:{_NODE}|{_LITERAL})\s*+\.\s*+(?:#.*)?$"
SKIPPED = r"^\s*(#.*)?$"
_CUT = "\x00"
# fixed values of the N-Triples grammar: what an IRI may not hold, labels of blank nodes, language tags
_NOT_IN_IRIS = "".join(map(chr, range(0x21))) + '<>"{}|^`\\'
_PLAIN_LABEL = r"^_:[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?\z"
_LANGUAGE = r"^[A-Za-z0-9-]+\z"


# lines of a file of N-Triples: compressed files are read whole, each by one task
LINES_A_FILE = 1 << 20
# files that a task of a write has open at once, one per predicate
OPEN_FILES = 64


def write_graph(triples: DataFrame, path: str, distinct: bool = False, by_predicate: bool = False) -> None:
    """Write triples as parquet, one directory per predicate; *distinct* says there are no duplicates, and *by_predicate*
    that they come from files by predicate: each task then meets few of them, and nothing is shuffled.

    Rebalancing gives each predicate its own files and splits a predicate that
    holds most of the graph. A task writes the predicates it meets side by side: IRIs that are much alike
    take some thirty times the room of their shuffled bytes, and sorting them by predicate would hold all of them.
    Only rows of further predicates than ``OPEN_FILES`` are sorted. Writing over a graph that is being read is
    refused by the 'error if exists' mode: write every version to a new path.
    """
    rows = triples.select(*TRIPLE_COLUMNS)
    rows = rows if distinct else distinct_rows(rows)
    with using(triples.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        (rows if by_predicate else rows.hint("rebalance", "p")).write.partitionBy("p").parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Triples of a parquet graph; filters on ``p`` prune directories."""
    return spark.read.schema(TRIPLE).parquet(path).select(*TRIPLE_COLUMNS)


def _node(text: Column) -> Column:
    return F.when(text.startswith("<"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def _surrogates(digits: Column) -> Column:
    """Escapes of UTF-16 for the eight hexadecimal digits of a code point."""
    code = F.conv(digits, 16, 10).cast("long")
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000) % 0x400
    return F.when(code < 0x10000, F.concat(F.lit("\\u"), F.substring(digits, 5, 4))).when(
        code <= 0x10FFFF, F.concat(F.lit("\\u"), F.hex(high), F.lit("\\u"), F.hex(low)))


def _unescape(literal: Column) -> Column:
    r"""Resolve the escapes of a literal or IRI. They are those of JSON, but for \' and \UXXXXXXXX; NULL if one is none."""
    text = F.replace(literal, F.lit("\\\\"), F.lit("\\u005c"))
    text = F.replace(text, F.lit("\\'"), F.lit("'"))
    parts = F.split(text, r"\\U")  # pairs of backslashes are gone, so each of these is an escape
    wide = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(
        x.rlike("^[0-9A-Fa-f]{8}"), F.concat(_surrogates(F.substring(x, 1, 8)), F.substring(x, F.lit(9), F.length(x)))))
    # a part that is no escape is NULL, and so is the whole
    text = F.aggregate(wide, F.get(parts, F.lit(0)), lambda a, x: F.concat(a, x))
    parsed = F.from_json(
        F.concat(F.lit('["'), text, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    return F.when(literal.contains("\\"), F.get(parsed, F.lit(0))).otherwise(literal)


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """Lines (``value``) to triples plus ``bad_line`` for lines that are not N-Triples.

    One match of the whole line writes its parts one after the other, the literal last.
    """
    line = F.col("value")
    cut = F.split(F.regexp_replace(line, LINE, _CUT.join(["", "$1", "$2", "$3", "$5", "$6", "$4"])), _CUT, 7)
    good = ~line.startswith(_CUT) & F.get(cut, F.lit(0)).eqNullSafe("") & (F.size(cut) == 7)
    part = {name: F.get(F.col("_parts"), F.lit(i)) for i, name in enumerate(("_", "s", "p", "node", "lang", "datatype", "text"))}
    is_node = part["node"] != ""
    obj = F.when(is_node, _unescape(_node(part["node"]))).otherwise(_unescape(part["text"]))
    rows = lines.where(~line.rlike(SKIPPED)).select(F.when(good, cut).alias("_parts"), line.alias("_line")).select(
        _unescape(_node(part["s"])).alias("s"), _unescape(part["p"]).alias("p"), obj.alias("o"),
        F.when(is_node, "iri").otherwise("literal").alias("o_kind"), F.coalesce(part["lang"], F.lit("")).alias("o_lang"),
        F.when(part["datatype"] == v.STRING, "").otherwise(F.coalesce(_unescape(part["datatype"]), F.lit(""))).alias("o_datatype"),
        "_line")
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    return rows.withColumn("bad_line", F.when(~whole, F.col("_line"))).drop("_line")


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Distinct triples of N-Triples files. A line that does not parse fails the job with its text; without *strict*
    such lines are left out, and ``ntriples_report`` counts them."""
    parsed = parse_ntriples(spark.read.text(path))
    bad = F.col("bad_line").isNotNull()
    if strict:
        shown = F.concat(F.lit("not a line of N-Triples: "), F.substring("bad_line", 1, 200))
        parsed = parsed.withColumn("s", F.when(bad, F.raise_error(shown).cast("string")).otherwise(F.col("s")))
    else:
        parsed = parsed.where(~bad)
    return distinct_rows(parsed.select(*TRIPLE_COLUMNS))


def ntriples_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that are triples, and lines that do not parse."""
    bad = F.col("bad_line").isNotNull()
    return parse_ntriples(spark.read.text(path)).agg(
        F.count_if(~bad).alias("n_triples"), F.count_if(bad).alias("n_bad"))


def _escaped_iri(text: Column) -> Column:
    r"""An IRI with what may not stand in one as \uXXXX: blanks, control characters and a few signs."""
    shown = F.replace(text, F.lit("\\"), F.lit("\\u005C"))
    for sign in _NOT_IN_IRIS.replace("\\", ""):
        shown = F.replace(shown, F.lit(sign), F.lit(f"\\u{ord(sign):04X}"))
    return F.when(text.rlike("[" + "".join(f"\\x{ord(sign):02x}" for sign in _NOT_IN_IRIS) + "]"), shown).otherwise(text)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple, as ``value``. Any text may stand in a node; a language tag must be one.

    A blank node whose label N-Triples does not allow is written between angle brackets, and is read as it was.
    """
    def iri(text: Column) -> Column:
        return F.concat(F.lit("<"), _escaped_iri(text), F.lit(">"))

    def node(text: Column) -> Column:
        return F.when(text.rlike(_PLAIN_LABEL), text).otherwise(iri(text))

    escaped = F.col("o")
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    tag = F.when(F.col("o_lang").rlike(_LANGUAGE), F.col("o_lang")).otherwise(
        F.raise_error(F.concat(F.lit("not a language tag: "), "o_lang")).cast("string"))
    suffix = (
        F.when(F.col("o_lang") != "", F.concat(F.lit("@"), tag))
        .when(F.col("o_datatype") != "", F.concat(F.lit("^^"), iri(F.col("o_datatype")))).otherwise(""))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), suffix)
    obj = F.when(F.col("o_kind") == "iri", node(F.col("o"))).otherwise(literal)
    return triples.select(
        F.concat(node(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), obj, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, distinct: bool = False) -> None:
    """Write each triple once, as N-Triples compressed by gzip: the lines repeat their IRIs, and those of the given
    graph are some 24 times smaller so. *distinct* says there are no duplicates; then nothing is shuffled."""
    rows = triples.select(*TRIPLE_COLUMNS)
    lines = ntriples_lines(rows if distinct else distinct_rows(rows))
    lines.write.option("maxRecordsPerFile", LINES_A_FILE).text(path, compression="gzip")


def write_geojson_lines(lines: DataFrame, path: str) -> None:
    """Write the output of ``geojson_lines``: one feature per line, one file per task."""
    lines.write.text(path)
