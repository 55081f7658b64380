"""Joins whose left side may hold a large share of its rows under one key.

Adaptive execution splits a hot key only where both inputs of a join come straight
from a shuffle, and rows with a NULL key, which match nothing, all hash alike.
``spread_join`` adds one join column that takes care of both: it is 0 for every row
that can match, so results are those of a plain join, and some other number for
rows that cannot, which spreads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# rows with a NULL key go to this many groups
NULL_GROUPS = 4096
# a table of at most this many rows is sent to every task. The optimizer goes by the size of files, and rows of IRIs
# that are much alike take some forty times the room in memory
SENT_ROWS = 1 << 16
# the filter that stands for a table of more rows: bits a row, and 64-bit words at most
FILTER_BITS = 16
FILTER_WORDS = 1 << 21
# words of the filter that are looked up together
BLOCK_WORDS = 64


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join of *left*, which may be skewed, with *right*; how is inner, left, left_semi or left_anti.

    The join column keeps an aggregated right side from being joined where its groups
    are, so both inputs are shuffle stages whose large partitions adaptive execution
    can split. Whether a side is broadcast stays the optimizer's choice, by its size.
    """
    on = [on] if isinstance(on, str) else on
    # no constant: the optimizer would take a constant out of the join keys
    zero = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(1))
    unmatched = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in on])
    group = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(NULL_GROUPS)) + 1
    if how in ("inner", "left_semi"):  # rows without a key go before the shuffle
        group = F.lit(None)
    return (
        left.withColumn("_spread", F.when(unmatched, group).otherwise(zero))
        .join(right.withColumn("_spread", zero), [*on, "_spread"], how).drop("_spread")
    )


def filter_words(rows: int) -> int:
    """Words of the filter for so many rows, a power of two."""
    return min(FILTER_WORDS, 1 << max(0, FILTER_BITS * rows // 64 - 1).bit_length())


def _filtered(large: DataFrame, keys: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Rows of *large* with ``_may``: whether their key may be among *keys*, which are so many *rows*.

    What is sent is a Bloom filter of two bits a key that lie in one block. It grows with the keys up to a bound, so
    that the share of other rows that pass stays the same (some 2 in 100) until that bound.
    """
    words = filter_words(rows)
    wide = min(BLOCK_WORDS, words)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    block = F.pmod(F.col("_key"), F.lit(words // wide)).alias("_block")
    bits = [F.shiftright("_key", at).bitwiseAND(64 * wide - 1).cast("int") for at in (32, 48)]
    filled = keys.select(key.alias("_key")).select(block, F.explode(F.array(*bits)).alias("_bit")).groupBy(
        "_block", F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _bit % 64)")).alias("_bits"))
    by_word = filled.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_bits"))
    blocks = by_word.select("_block", F.transform(
        F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.coalesce(F.try_element_at("_bits", i), F.lit(0).cast("long"))).alias("_words"))
    hit = [F.getbit(F.get("_words", F.shiftright(bit, 6)), bit % 64) == 1 for bit in bits]
    return (
        large.withColumn("_key", key).withColumn("_block", block).join(F.broadcast(blocks), "_block", "left")
        .withColumn("_may", F.coalesce(hit[0] & hit[1], F.lit(False))).drop("_block", "_key", "_words")
    )


def has_few_rows(rows: DataFrame) -> bool:
    return rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS


def join_written(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join of *large* with *small*, which is read from files; how is inner, left_semi or left_anti.

    A *small* of few rows, by count, is broadcast. Of a larger one only a filter of bounded size is: rows that may match
    are shuffled with it, all others are dropped, or kept by left_anti, where they are read. Of none, *large* is not
    joined, nor read unless it is kept.
    """
    on = [on] if isinstance(on, str) else on
    if how != "inner":
        small = small.select(*on)
    count = small.count()
    if count == 0:
        return large if how == "left_anti" else large.where(F.lit(False)).join(small, on, how)
    if count <= SENT_ROWS:
        return large.join(F.broadcast(small if how == "inner" else small.distinct()), on, how)
    marked = _filtered(large, small, on, count)
    met = spread_join(marked.where("_may").drop("_may"), (small if how == "inner" else small.distinct()).hint("merge"), on, how)
    return met.unionByName(marked.where("not _may").drop("_may")) if how == "left_anti" else met


def may_match(large: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of *large* whose key is in *small*, which is read from files, and if it has many rows few others."""
    on = [on] if isinstance(on, str) else on
    keys = small.select(*on)
    count = keys.count()
    if count <= SENT_ROWS:
        return large.join(F.broadcast(keys.distinct()), on, "left_semi")
    return _filtered(large, keys, on, count).where("_may").drop("_may")


def sized(written: DataFrame) -> DataFrame:
    """A table that is read from files, for a join: broadcast if its rows are few, else always shuffled."""
    return F.broadcast(written) if has_few_rows(written) else written.hint("merge")
