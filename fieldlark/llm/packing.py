"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so documents of one length are alike
and only how many there are of each length matters. Counts are gathered per length
(at most as many rows as the capacity), and best fit decreasing runs on them: a
segment tree over remaining capacities finds the tightest open bins in logarithmic
time, and all documents of a length that go into alike bins are placed in one step.
The outcome is a list of rules (length, ranks, first bin, offset), small whatever
the number of documents; a document finds its place by its rank among its length.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fieldlark.session import cut_lineage

CAPACITY = 4096
END_ID = 1
TEXTS = 250  # looked up together
CACHE = 250_000  # chunks of text whose ids a task remembers

_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_WORD_AND_SIGNS = re.compile("([a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-^`{-~]*)")


class Rule(NamedTuple):
    """Items of *length* with ranks [first, first + count): *per_bin* in a row from *offset* on, in bins from *bin* on."""
    length: int
    first: int
    count: int
    bin: int
    per_bin: int
    offset: int


class Tightest:
    """Segment tree over remaining capacities: which have open bins, and the least of those from a size on."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        i = capacity + self.size
        self.any[i] = some
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def find(self, least: int) -> int | None:
        """The least capacity >= *least* with an open bin."""
        i = least + self.size
        while not self.any[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # stepped over the right edge of the level
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Rule], int]:
    """Rules for *counts* items of each length, and the number of bins. The longest items go first; each goes into
    the open bin that it fills best, a new bin if it fits in none."""
    tree, runs = Tightest(capacity), defaultdict(list)  # remaining capacity -> [(first bin, bins)]
    rules, bins = [], 0

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            runs[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no item of length {length} fits into {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                room, per = capacity, capacity // length
                n = -(-left // per)
                runs[room].append((bins, n))
                bins += n
            first, n = runs[room].pop()
            per = room // length
            full = min(n, left // per)
            if full:
                rules.append(Rule(length, rank, full * per, first, per, capacity - room))
                give(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                rest = n - full
                if 0 < left < per:
                    rules.append(Rule(length, rank, left, first + full, left, capacity - room))
                    give(room - left * length, first + full, 1)
                    rank, left = rank + left, 0
                    full, rest = full + 1, rest - 1
                if rest:
                    runs[room].append((first + full, rest))
            tree.set(room, bool(runs[room]))
    return rules, bins


class ChunkIds:
    """Ids of texts as little-endian 32-bit numbers, by way of their chunks between spaces and line ends.

    The tokenizer splits at white space before it merges, so the ids of a text are those of its chunks, and ids of
    chunks are remembered up to a bound. Lower case is taken first only where that cannot change what the
    tokenizer's own normalisation gives. A run of letters is one unit to the tokenizer, and so is a run of other
    signs after it; the last id of a unit is one that ends a word. So new words are encoded many at a time, and the
    ids are cut where a word ends. Of words in lower case the tokenizer's normalisation changes nothing and its
    pattern cuts nothing, so they go to its model without these two steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        of_words = Tokenizer(self.tokenizer.model)
        of_words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_words = getattr(of_words, "encode_batch_fast", of_words.encode_batch)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for token, i in words.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.known) > CACHE:  # the first to be met are the most frequent ones
            self.known = dict(islice(self.known.items(), CACHE // 2))
        chunked = []
        for text in texts:
            text = text or ""
            if "<|" not in text and (text.isascii() or not _BEYOND_LATIN.search(text)):
                text = text.lower()
            chunked.append(text.replace("\n", " ").split(" "))
        self.learn(set().union(*chunked).difference(self.known))
        for chunks in chunked:
            yield b"".join(map(self.known.__getitem__, chunks))

    def learn(self, chunks: set[str]) -> None:
        parts, words, others = {}, set(), set()
        for chunk in chunks:
            m = _WORD_AND_SIGNS.fullmatch(chunk)
            if m is None:
                others.add(chunk)
            else:
                words.add(m[1])
                if m[2]:
                    parts[chunk] = m[1], m[2]
                    others.add(m[2])
        known = self.known
        words = list(words.difference(known))
        for a in range(0, len(words), 20_000):
            some = words[a: a + 20_000]
            ids = []
            lines = [" ".join(some[i: i + 64]).lower() for i in range(0, len(some), 64)]
            for e in self.encode_words(lines, add_special_tokens=False):
                ids += e.ids
            ids = np.array(ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            data, cuts = ids.tobytes(), [0, *cuts.tolist()]
            assert len(cuts) == len(some) + 1
            known.update(zip(some, (data[x:y] for x, y in zip(cuts, cuts[1:]))))
        others = list(others.difference(known))
        for a in range(0, len(others), 20_000):
            some = others[a: a + 20_000]
            known.update(zip(some, (
                np.array(e.ids, "<u4").tobytes() for e in self.encode(some, add_special_tokens=False))))
        for chunk, (word, signs) in parts.items():
            known[chunk] = known[word] + known[signs]


def pieces(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every text's ids (and the end id): id, piece, start, length, ids_crc32, and with *keep_ids* the
    ids themselves. Only documents longer than *capacity* are cut. ``part`` and ``rank`` number the pieces of a
    length within a task."""
    kinds = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "part": "long", "rank": "long"}
    if keep_ids:
        kinds["ids"] = "binary"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunk_ids, seen = ChunkIds(tokenizer_path), defaultdict(int)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                some = batch.slice(a, TEXTS)
                of, rows, ids = [], [], []
                for i, data in enumerate(chunk_ids.of(some.column("__text").to_pylist())):
                    data += end
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        cut = data[4 * start: 4 * (start + capacity)]
                        length = len(cut) // 4
                        of.append(i)
                        rows.append((piece, start, length, zlib.crc32(cut), part, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            ids.append(cut)
                columns = list(zip(*rows)) or [()] * 6
                out = [some.column("__id").take(pa.array(of, pa.int64()))] + [
                    pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds.values())]
                if keep_ids:
                    out.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["__id", *kinds])

    source = df.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text_column}`").alias("__text"))
    schema = f"__id {source.schema['__id'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    return source.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece with its place: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are one end id. Repeated rows are packed as often as they occur; ties between pieces of a
    length go by where they were read. Other columns are left out; an empty table gives no rows. The number of
    sequences is what best fit decreasing gives for the counts per length.
    """
    spark = df.sparkSession
    # written once: the ranks within a task must stay as they are
    found = cut_lineage(pieces(df, tokenizer_path, id_column, text_column, capacity, end_id, keep_ids), "pieces")
    per_part = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules, _ = best_fit_decreasing(counts, capacity)
    rules.sort()
    sent = spark.sparkContext.broadcast(np.array(rules, np.int64).reshape(-1, 6))  # grows with the capacity only

    def run(batches):
        table = sent.value
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            rank = rank + batch.column("before").to_numpy()
            rule = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            k = rank - rule[:, 1]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("part", "rank", "before")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rule[:, 3] + k // rule[:, 4]), pa.array(rule[:, 5] + k % rule[:, 4] * length)],
                names=[*(c for c in batch.schema.names if c not in ("part", "rank", "before")), "sequence_id", "offset"])

    placed = found.join(first, ["length", "part"])
    names = ["__id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    placed = placed.select(*names, "part", "rank", "before")
    schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in names)
    return placed.mapInArrow(run, schema + ", sequence_id long, offset long").withColumnRenamed("__id", id_column)
