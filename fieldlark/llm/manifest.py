"""Merkle manifest of a dataset: a hash tree per source, one over the sources, and a proof for every document.

Per level, a window over each run of 16 nodes looks at the fixed offsets before
and behind a node; masked by the node's slot and the length of its run these lag
and lead columns are its siblings, and the first child of a run hashes the parent.
Going up, only (group, place, digest) is kept, a sixteenth of it on each level;
going down, a node takes over what its parent has, so nothing meets by source.
A window never holds more than 16 rows, whatever the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.llm.ranks import GROUP, POS, SIZE, ranked
from fieldlark.session import cut_lineage

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONE_GROUP = "all"


def digest_of(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(digests: Column) -> Column:
    """Digests, one or several end to end, as lowercase hex."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest_of(*[field(c) for c in fields])


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """*nodes* of one level with __left and __right: the digests of the others of a node's run, end to end.

    A group's only node has no run, so no siblings.
    """
    run = Window.partitionBy(GROUP, "__run").orderBy(POS)
    slot, length = F.pmod(F.col(POS), F.lit(FAN_OUT)), F.least(F.lit(FAN_OUT), F.col(SIZE) - F.col("__run") * FAN_OUT)
    none = F.lit(b"")
    offsets = range(1, FAN_OUT)
    before = [F.when(slot >= k, F.lag("__digest", k).over(run)).otherwise(none) for k in reversed(offsets)]
    behind = [F.when(slot + k < length, F.lead("__digest", k).over(run)).otherwise(none) for k in offsets]
    return nodes.withColumn("__run", run_of(F.col(POS))).withColumns(
        {"__left": F.concat(*before), "__right": F.concat(*behind)})


def run_of(pos: Column) -> Column:
    return F.floor(pos / FAN_OUT) if FAN_OUT & (FAN_OUT - 1) else F.shiftright(pos, FAN_OUT.bit_length() - 1)


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes the run. A group's only node stays as it is."""
    only = F.col(SIZE) == 1
    return with_siblings(nodes).where(F.pmod(F.col(POS), F.lit(FAN_OUT)) == 0).select(
        GROUP, F.col("__run").alias(POS), F.ceil(F.col(SIZE) / FAN_OUT).cast("long").alias(SIZE),
        F.when(only, F.col("__digest")).otherwise(digest_of(as_text(F.col("__digest")), as_text(F.col("__right"))))
        .alias("__digest"))


def climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """All levels from (__group, __pos, __size, __digest) rows up to one node per group."""
    largest = nodes.agg(F.max(SIZE)).first()[0] or 0  # one number
    levels = [nodes]
    while largest > 1:
        levels.append(cut_lineage(parents(levels[-1]), label))
        largest = -(-largest // FAN_OUT)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, given: list[str]) -> DataFrame:
    """The lowest level with the columns *given* of its top and ``__path``: (before, behind) siblings from below to the top.

    *tops* has __group, the *given* columns and the __path that goes on from the top of each group.
    """
    known = levels[-1].join(tops, GROUP)
    for nodes in reversed(levels[:-1]):
        step = F.array(F.struct(F.col("__left").alias("before"), F.col("__right").alias("behind")))
        above = known.select(GROUP, F.col(POS).alias("__run"), *given, F.col("__path").alias("__above"))
        known = with_siblings(nodes).join(above, [GROUP, "__run"]).withColumn(
            "__path", F.when(F.col(SIZE) == 1, F.col("__above")).otherwise(F.concat(step, "__above"))
        ).drop("__run", "__left", "__right", "__above")
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a digest leads to along its siblings."""
    return F.aggregate(path, start, lambda at, x: digest_of(
        as_text(x["before"]), as_text(at), as_text(x["behind"])))


def build_manifest(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, siblings, proof_sha256, folded_root, verified.

    *documents* has doc_id, source, lang, n_chars and text; other columns are left aside. A leaf is the hash of
    these five, null or not. Per source (null is a source of its own and the first; the empty text is another), leaves
    ascend by doc_id, null first; rows of equal doc_id follow by their leaf, so repeated rows have places of their
    own next to each other. ``siblings`` holds the path: per level the digests before and behind, end to end, as
    bytes. ``folded_root`` starts from the leaf of the document as it would be tampered with: where 5 divides the
    CRC-32 of the decimal doc_id, A-Z of the text in lower case; ``verified`` tells whether it is the root. A
    document without a doc_id is never tampered with. A single document is leaf, subroot and root in one, its proof
    is the hash of nothing. An empty table gives no rows.
    """
    plain = [F.col(c) for c in FIELDS]
    changed = [*plain[:-1], F.translate("text", UPPER, LOWER)]
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    hashed = documents.select(
        "doc_id", source_key(F.col("source")).alias("__source"), leaf(plain).alias("__digest"),
        F.when(tampered, leaf(changed)).alias("__tampered"))
    leaves = cut_lineage(
        ranked(hashed, F.col("__source"), [F.col("doc_id"), F.col("__digest")], "manifest-leaves").drop("__source"),
        "manifest-leaves")

    levels = climb(leaves, "manifest-level")
    subroots = levels[-1].select(F.col(GROUP).alias("__source"), F.col("__digest").alias("__subroot"))
    sources = cut_lineage(ranked(
        subroots.withColumn("__digest", F.col("__subroot")), F.lit(ONE_GROUP), [F.col("__source")], "manifest-sources"),
        "manifest-sources")
    upper = climb(sources, "manifest-level")
    no_steps = F.array().cast("array<struct<before:binary,behind:binary>>")
    root = upper[-1].select(GROUP, F.col("__digest").alias("__root"), no_steps.alias("__path"))
    tops = cut_lineage(descend(upper, root, ["__root"]).select(
        F.col("__source").alias(GROUP), "__subroot", "__root", "__path"), "manifest-sources")

    known = descend(levels, tops, ["__subroot", "__root"])
    siblings = F.aggregate("__path", F.lit(b""), lambda a, x: F.concat(a, x["before"], x["behind"]))
    end = folded(F.coalesce("__tampered", "__digest"), F.col("__path"))
    return known.withColumn("__end", end).select(
        "doc_id", as_text(F.col("__digest")).alias("leaf"), as_text(F.col("__subroot")).alias("subroot"),
        as_text(F.col("__root")).alias("root"), F.col("__path").alias("siblings"),
        F.sha2(as_text(siblings).cast("binary"), 256).alias("proof_sha256"),
        as_text(F.col("__end")).alias("folded_root"), (F.col("__end") == F.col("__root")).alias("verified"))
