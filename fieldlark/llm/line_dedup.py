"""Removal of lines that many documents share.

Every line gets a normalised key; keys are hashed and the different documents of
each hash are counted. Lines of keys found in too many documents go, but for
those of one document, and the others are put together again by position.

Hashes, ids and positions of lines are written once and shuffled, and of the texts only
those that may lose a line, beside the array of their dropped positions. A key or a
document may hold a third of all rows: documents are counted as different (key,
document) pairs before they meet by key, and the joins are such that adaptive
execution can split a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from fieldlark.llm.bloom import bitmap, marked
from fieldlark.operators.joins import spread_join
from fieldlark.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"  # fixed values: the white space of ASCII
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE, ROW = ["__h1", "__h2"], ["__k1", "__k2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def two_hashes(*values: Column) -> list[Column]:
    """128 bits of the values, from two seeds."""
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """*df* with two hashes of its id and text. Rows equal in both share all decisions."""
    first, second = two_hashes(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    return df.withColumns({"__k1": first, "__k2": second})


def long_lines(df: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """(__k1, __k2, __doc, __pos, __h1, __h2): the lines of a keyed table that may be dropped, with the hash of their key."""
    first, second = two_hashes(F.translate("__key", UPPER, LOWER))
    return (
        df.select(*ROW, F.col(f"`{id_column}`").alias("__doc"),
                  F.posexplode(lines_of(F.col(f"`{text_column}`"))).alias("__pos", "__line"))
        .withColumn("__key", stripped(F.col("__line")))
        .where(F.char_length("__key") >= min_chars)
        .select(*ROW, "__doc", "__pos", first.alias("__h1"), second.alias("__h2"))
    )


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(__h1, __h2, __keeper): the hashes found in at least *min_docs* documents and the largest of those."""
    return (
        lines.where(F.col("__doc").isNotNull()).groupBy(LINE)
        .agg(F.count_distinct("__doc").alias("__docs"), F.max("__doc").alias("__keeper"))
        .where(F.col("__docs") >= min_docs).select(*LINE, "__keeper")
    )


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``__kept``: the lines of ``__text`` whose positions are not in ``__dropped``, put together again."""
    for batch in batches:
        kept = []
        for text, dropped in zip(batch.column("__text").to_pylist(), batch.column("__dropped").to_pylist()):
            gone = set(dropped or ())
            kept.append("\n".join(line for i, line in enumerate((text or "").split("\n")) if i not in gone))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())], names=[*batch.schema.names, "__kept"])


def drop_repeated_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """*df* with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced.

    A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Keys of at least
    *min_chars* code points that stand in at least *min_docs* different documents lose all their lines except those
    of the document with the largest id. How often a document holds a line does not matter. Rows with the same id
    are one document, whatever their texts. Rows without an id count as no document: they make no key frequent and
    keep none, but lose the lines that others make frequent. Null and empty texts have one empty line, which stays.
    Row count and all other columns stay as they are; an empty table gives an empty result.
    """
    names = [c for c in df.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    docs = keyed(df.select(*[F.col(f"`{c}`") for c in names]), id_column, text_column)
    lines = cut_lineage(long_lines(docs, id_column, text_column, min_chars), "long-lines")
    frequent = cut_lineage(repeated_keys(lines, min_docs), "repeated-lines")
    maybe = marked(lines, "__h1", bitmap(frequent, "__h1"), "__maybe").where("__maybe")
    dropped = cut_lineage(
        spread_join(maybe.drop("__maybe"), frequent, LINE)
        .where("__doc is null or __doc < __keeper")
        .groupBy(ROW).agg(F.array_sort(F.collect_set("__pos")).alias("__dropped")), "dropped-lines")

    flagged = marked(docs, "__k1", bitmap(dropped, "__k1"), "__touched")
    touched = spread_join(flagged.where("__touched"), dropped, ROW, "left")
    columns = [F.col(f"`{c}`") for c in names]
    # under plain names: rows do not go to Python with a dot in the name of a column
    both = touched.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text_column}`").alias("__text"), "__dropped")
    put = both.mapInArrow(without_lines, T.StructType([*both.schema.fields, T.StructField("__kept", T.StringType())]))
    put = put.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "__dropped", "__kept")

    def result(rows: DataFrame, kept: Column, n_dropped: Column) -> DataFrame:
        return rows.select(
            *columns, kept.alias("kept_text"), F.size(lines_of(F.col(f"`{text_column}`"))).cast("long").alias("n_lines"),
            n_dropped.cast("long").alias("n_dropped"))

    gone = F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped"))
    return result(put, F.col("__kept"), gone).unionByName(result(
        flagged.where("not __touched"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")), F.lit(0)))
