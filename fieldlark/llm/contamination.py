"""Benchmark decontamination with suffix arrays over shards of the training words.

The benchmark is the stated query set. A task cuts its documents into shards of
bounded size and sorts the suffixes of each shard's word sequence. Suffixes whose
first words begin no test window are left out of the array beforehand: no search
could end at them. Every window of the test suffixes is then found by two binary
searches, which give all its occurrences; the suffixes found are compared further
with the test suffix to get the longest verbatim match and where it stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldlark.llm.words import SpanHasher, normal_bytes, word_hashes
from fieldlark.session import cut_lineage

WINDOW = 10  # words
DEPTH = 32  # words of a suffix that sorting looks at; longer matches are compared word by word
SHARD_BYTES = 4 << 20  # text in one suffix array; a longer document is a shard of its own
BLOCK_WORDS = 1 << 20  # words of test items searched for in one pass


@dataclass
class TestSet:
    """Search side of some items, with words as numbers from 1 on in the order of their hashes."""
    items: list[str]
    vocabulary: np.ndarray
    text: np.ndarray  # words of all items, each item followed by DEPTH zeros
    low: np.ndarray  # distinct windows as sortable keys, and the greatest key each is a prefix of
    high: np.ndarray
    width: np.ndarray  # words of each window
    uses: tuple[np.ndarray, np.ndarray, np.ndarray]  # window -> places: sorted window number, item, place in text
    starts: dict[int, np.ndarray]  # number of words -> what windows can begin with


def sort_keys(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """*depth* words from each place, as byte strings that sort like the words. *words* end in *depth* zeros."""
    rows = words[at[:, None] + np.arange(depth)].astype(">u4")
    # nothing follows the end of a text
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()


def packed(words: np.ndarray, n: int) -> np.ndarray:
    """One number per place for the next *n* (up to 3) words; places that meet a zero give 0."""
    last = len(words) - n + 1
    out, sound = np.zeros(last, np.uint64), np.ones(last, bool)
    for k in range(n):
        x = words[k: last + k]
        out = out << np.uint64(21) | x.astype(np.uint64)
        sound &= x > 0
    return np.where(sound, out, np.uint64(0))


def test_set(items: list[tuple[str, str]], window: int = WINDOW) -> TestSet:
    hasher = SpanHasher()
    hashes = [(name, word_hashes(hasher, normal_bytes(text))) for name, text in items]
    hashes = [(name, h) for name, h in hashes if len(h)]
    vocabulary = np.unique(np.concatenate([h for _, h in hashes] or [np.empty(0, np.uint64)]))
    depth = max(DEPTH, window)
    gap = np.zeros(depth, np.int64)
    text, item, place, width, base = [], [], [], [], 0
    for i, (_, h) in enumerate(hashes):
        text += [np.searchsorted(vocabulary, h) + 1, gap]
        n = max(len(h) - window + 1, 1)
        item.append(np.full(n, i))
        place.append(base + np.arange(n))
        width.append(np.full(n, min(window, len(h))))
        base += len(h) + depth
    text = np.concatenate([*text, gap])
    if not hashes:
        empty = np.empty(0, np.int64)
        return TestSet([], vocabulary, text, np.empty(0, "S4"), np.empty(0, "S4"), empty, (empty, empty, empty), {})
    item, place, width = map(np.concatenate, (item, place, width))
    rows = text[place[:, None] + np.arange(depth)]
    rows[np.arange(depth) >= width[:, None]] = 0
    low = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * depth}").ravel()
    rows[np.arange(depth) >= width[:, None]] = 2**32 - 1
    high = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * depth}").ravel()
    low, first, number = np.unique(low, return_index=True, return_inverse=True)
    order = np.argsort(number, kind="stable")
    starts = {}
    for n in (1, 2, 3):
        own = place[np.minimum(width, 3) == n]
        if len(own):
            starts[n] = np.unique(packed(text, n)[own])
    return TestSet([name for name, _ in hashes], vocabulary, text, low, high[first], width[first],
                   (number[order], item[order], place[order]), starts)


def search(test: TestSet, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of all windows in *words* (numbers, texts held apart and ended by zeros): place in words, words of the
    window, item, place in the test text."""
    none = np.empty(0, np.int64)
    if not len(test.low) or not len(words):
        return none, none, none, none
    depth = test.low.dtype.itemsize // 4
    can = np.zeros(len(words), bool)
    for n, begin in test.starts.items():
        key = packed(words, n)
        at = np.minimum(np.searchsorted(begin, key), len(begin) - 1)
        can[: len(key)] |= (begin[at] == key) & (key > 0)
    at = np.flatnonzero(can)
    if not len(at):
        return none, none, none, none
    keys = sort_keys(np.concatenate([words, np.zeros(depth, words.dtype)]), at, depth)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]  # the suffix array
    left, right = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    number, item, place = test.uses
    left, n = left[number], (right - left)[number]
    found = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return array[found], np.repeat(test.width[number], n), np.repeat(item, n), np.repeat(place, n)


def match_lengths(test: TestSet, words: np.ndarray, at: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many words agree from *at* in words and *place* in the test text on; *known* are known to."""
    length, going = known.copy(), np.arange(len(at))
    while len(going):
        a, b = at[going] + length[going], place[going] + length[going]
        inside = (a < len(words)) & (b < len(test.text))
        going, a, b = going[inside], a[inside], b[inside]
        going = going[(words[a] == test.text[b]) & (words[a] > 0)]
        length[going] += 1
    return length


def scan(test: TestSet, hasher: SpanHasher, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list]]:
    """Per text: number of words, mask of hit words, and per item found (item, longest match, word of the text, word of the item)."""
    hashes = [word_hashes(hasher, normal_bytes(t)) for t in texts]
    lengths = np.array([len(h) for h in hashes])
    base = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    flat = np.concatenate([x for h in hashes for x in (h, np.zeros(1, np.uint64))])
    if len(test.vocabulary):
        index = np.minimum(np.searchsorted(test.vocabulary, flat), len(test.vocabulary) - 1)
        words = np.where(test.vocabulary[index] == flat, index + 1, 0)
        words[base[1:] - 1] = 0
    else:
        words = np.zeros(len(flat), np.int64)
    at, width, item, place = search(test, words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    hit = np.cumsum(edge)[:-1] > 0
    found: list[list] = [[] for _ in texts]
    if len(at):
        long = match_lengths(test, words, at, place, width)
        doc = np.searchsorted(base, at, "right") - 1
        order = np.lexsort((place, at, -long, item, doc))
        first = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)])
        origin = np.full(len(test.items), len(test.text))
        np.minimum.at(origin, test.uses[1], test.uses[2])
        for k in order[first]:
            found[doc[k]].append((test.items[item[k]], int(long[k]), int(at[k] - base[doc[k]]), int(place[k] - origin[item[k]])))
    for i, n in enumerate(lengths):
        yield int(n), hit[base[i]: base[i] + n], found[i]


ADDED = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "match_words": "array<long>",
         "match_at": "array<long>", "match_item_at": "array<long>"}
_KINDS = [pa.int64()] * 3 + [pa.list_(pa.string())] + [pa.list_(pa.int64())] * 3


def find(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """*docs* with n_words, n_hit (words inside an occurrence of a test window), n_items, and per item found, in the
    order of items as text: items, match_words (longest verbatim match), match_at and match_item_at (word where it
    starts in the document and in the item). Columns of these names are replaced.

    A window is *window* consecutive words of an item, or the whole of a shorter item. Null texts have no words, on
    both sides; items without words are found nowhere; items that share an id count once. Items are searched for in
    blocks of about *block_words* words, each in a pass of its own over the documents, which never move. Each row
    counts by itself, repeated ones too; an empty table, or no benchmark, finds nothing.
    """
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    items = items.distinct()
    # words by their pattern: what is left where each run of other characters is one blank
    plain = F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    words = items.agg(F.sum(F.when(plain != "", F.size(F.split(plain, " "))).otherwise(0)).alias("n")).first().n or 0
    n_blocks = max(1, math.ceil(words / block_words))
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ADDED]
    state = docs.select(
        *(F.col(f"`{c}`") for c in kept), *(F.lit(0).cast("long").alias(c) for c in list(ADDED)[:3]),
        *(F.array().cast(ADDED[c]).alias(c) for c in list(ADDED)[3:]), F.lit(None).cast("binary").alias("__hit"))
    for b in range(n_blocks):
        block = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast(test_set(block, window))
        last = b + 1 == n_blocks
        state = state.mapInArrow(
            lambda batches, sent=sent, last=last: _one_pass(batches, sent, text_column, last), state.schema)
        if not last:
            state = cut_lineage(state, "contamination")
    return state.drop("__hit")


def _one_pass(batches: Iterator[pa.RecordBatch], sent, text_column: str, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds what the items of one block find to what earlier blocks found; the masks go on only to a later block."""
    test, hasher = sent.value, SpanHasher()
    lists = list(ADDED)[3:]
    for batch in batches:
        texts = batch.column(text_column).to_pylist()
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < SHARD_BYTES):
                size += len(texts[stop] or "")
                stop += 1
            part = batch.slice(start, stop - start)
            before = zip(*(part.column(c).to_pylist() for c in ("__hit", *lists)))
            new: dict[str, list] = {c: [] for c in (*ADDED, "__hit")}
            for (n, mask, found), (hit, *old) in zip(scan(test, hasher, texts[start:stop]), before):
                if hit is not None:
                    mask = mask | (np.frombuffer(hit, np.uint8) > 0)
                best = {x[0]: x for x in zip(*old)}
                for x in found:
                    if x[0] not in best or (-x[1], x[2], x[3]) < (-best[x[0]][1], best[x[0]][2], best[x[0]][3]):
                        best[x[0]] = x
                rows = [best[k] for k in sorted(best)]
                values = (n, int(mask.sum()), len(rows), *([r[k] for r in rows] for k in range(4)),
                          None if last else mask.astype(np.uint8).tobytes())
                for c, value in zip(new, values):
                    new[c].append(value)
            arrays = {c: pa.array(v, k) for (c, v), k in zip(new.items(), (*_KINDS, pa.binary()))}
            yield pa.RecordBatch.from_arrays(
                [arrays.get(c, part.column(i)) for i, c in enumerate(part.schema.names)], names=part.schema.names)
            start = stop
