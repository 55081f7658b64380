"""Near duplicates: documents whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

A MinHash LSH forest finds candidates: each tree orders documents by a label, a
sequence of minhashes of their sets, and documents under one node of a tree share
a prefix of their labels. Prefixes are shortened from full depth until two
documents at the threshold share one in some tree with the target recall. Rows of
equal nodes meet sorted by node, in blocks of bounded size; a sketch of minhashes
drops pairs that are clearly below the threshold. What remains connected is
verified exactly, on the sets themselves, block against block. No list of pairs is
ever written: a document carries its number of links and its class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.llm import bloom
from fieldlark.llm.words import SpanHasher, mix, normal_bytes, shingle_hashes
from fieldlark.operators.closure import components
from fieldlark.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
TREES = 40
DEPTH = 10  # minhashes in a full label
RECALL = 1 - 1e-5  # of pairs at the threshold
SKETCH_EVERY = 3  # every third minhash gives a byte of the sketch
SIGMAS = 5  # a pair is dropped by the sketch if it is that many standard deviations below the threshold
FEW = 16  # rows of a tree node up to which all pairs are looked at
# rows compared at once, of a tree node and of a component: a group is cut into blocks of the first size, up to SPREAD
# blocks, and beyond that into as few blocks as the second size allows; RUNS bounds the runs of words in a block
NODE_BLOCK, SET_BLOCK = (512, 8192), (64, 2048)
SPREAD = 32
RUNS = 1 << 20
COLUMNS = 4096  # shingles in one tile of the comparison


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that two sets at the threshold share in at least one tree with the target recall: full
    labels first, one minhash less as long as the recall is missed."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


class Signer:
    """Minhashes of sets of 64-bit hashes, as node keys of each tree and a sketch."""

    def __init__(self, trees: int, length: int, seed: int = 11):
        draw = np.random.Generator(np.random.PCG64(seed))
        n = trees * length
        self.trees, self.length = trees, length
        self.xor = draw.integers(0, 2**32, n, dtype=np.uint32)
        self.times = draw.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.seed = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def minhashes(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.xor), 2**32 - 1, np.uint32)
        for a in range(0, len(x), 256):
            tile = x[a: a + 256, None] ^ self.xor
            tile *= self.times
            np.minimum(least, tile.min(0), out=least)
        return least

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        least = self.minhashes(hashes)
        label = least.reshape(self.trees, self.length).astype(np.uint64)
        node = self.seed.copy()
        for k in range(self.length):
            node = mix(node ^ label[:, k]) + np.uint64(k)
        return node.view(np.int64), (least[::SKETCH_EVERY] & np.uint32(255)).astype(np.uint8).tobytes()


def content_key(data: bytes) -> tuple[int, int]:
    """128 bits of a text's words in order."""
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame, trees: int, length: int, words: int) -> DataFrame:
    """(id, row, h1, h2, size, nodes, sketch) of each (id, text, row) row; all but the first two are null for a text
    without words.
    The size is the number of runs of words."""
    def run(batches):
        hasher, signer = SpanHasher(), Signer(trees, length)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                first, second, sizes, nodes, sketches = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    data = normal_bytes(text)
                    if not data:
                        for x in (first, second, sizes, nodes, sketches):
                            x.append(None)
                        continue
                    h1, h2 = content_key(data)
                    hashes = shingle_hashes(hasher, data, words)
                    node, sketch = signer.sign(hashes)
                    for x, value in ((first, h1), (second, h2), (sizes, len(hashes)), (nodes, node), (sketches, sketch)):
                        x.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(nodes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["id", "row", "h1", "h2", "size", "nodes", "sketch"])

    return docs.mapInArrow(run, "id long, row long, h1 long, h2 long, size long, nodes array<long>, sketch binary")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool = False) -> Iterator[pa.RecordBatch | pa.Table]:
    """Batches cut so that no run of equal *keys* of sorted rows is divided; with *whole*, one run at a time."""
    held: list[pa.RecordBatch] = []

    def key(batch, i):
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            changes[1:] |= x[1:] != x[:-1]
        changes[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        cuts = np.flatnonzero(changes)
        if not len(cuts):
            held.append(batch)
            continue
        if cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        if held:
            yield pa.Table.from_batches(held)
        if whole:
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
        elif len(cuts) > 1:
            yield pa.Table.from_batches([batch.slice(cuts[0], cuts[-1] - cuts[0])])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of the connected component of each of *n* points, given edges between *a* and *b*."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def reached(sketch: np.ndarray, least_equal: int) -> np.ndarray:
    """Least index of the connected component of each sketch, where an edge is to agree in enough places.

    A search from one sketch to all that are not reached yet: in a group of near copies the first step reaches
    nearly all, so the work is far below all pairs.
    """
    label, open_ = np.arange(len(sketch)), np.arange(len(sketch))
    while len(open_):
        root, open_ = open_[0], open_[1:]
        frontier = [root]
        while frontier and len(open_):
            near = np.count_nonzero(sketch[open_] == sketch[frontier.pop()], axis=1) >= least_equal
            found = open_[near]
            label[found] = root
            frontier += found.tolist()
            open_ = open_[~near]
    return label


def candidate_edges(batches: Iterator[pa.RecordBatch], least_equal: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from each document to the first document it is connected with under one tree node."""
    for part in runs(batches, ["node", "left", "right"]):
        key = [part.column(c).to_numpy() for c in ("node", "left", "right")]
        change = np.ones(part.num_rows, bool)
        change[1:] = False
        for k in key:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, part.num_rows))
        ids = part.column("id").to_numpy()
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(part.num_rows, -1)
        label = np.arange(part.num_rows)
        for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            label[start: start + size] = start + reached(sketch[start: start + size], least_equal)
        # groups of few rows, all at once: each row and the one d places on
        small = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
        group = np.repeat(starts, sizes)[small]
        a, b = [np.empty(0, int)], [np.empty(0, int)]
        for d in range(1, FEW):
            i = np.flatnonzero(group[d:] == group[:-d])
            if not len(i):
                break
            x, y = small[i], small[i + d]
            near = np.count_nonzero(sketch[x] == sketch[y], axis=1) >= least_equal
            a.append(x[near])
            b.append(y[near])
        label = np.minimum(label, joined(part.num_rows, np.concatenate(a), np.concatenate(b)))
        at = np.flatnonzero(label != np.arange(part.num_rows))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], names=["a", "b"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of sorted, distinct values."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((n, n))
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        edges = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                tile = np.zeros((n, COLUMNS), np.float32)
                tile[owner[a:b], column[a:b] % COLUMNS] = 1
                out += tile @ tile.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per document of a pair of blocks: its links across them, and the first document it is connected with there."""
    for part in runs(batches, ["component", "left", "right"], whole=True):
        ids, first = np.unique(part.column("node").to_numpy(), return_index=True)
        part = part.take(pa.array(first))
        sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
        copies, block = part.column("copies").to_numpy(), part.column("block").to_numpy()
        common = overlaps(sets)
        size = np.diag(common)
        # common / (size + size - common) >= threshold, in whole numbers where the threshold has up to three digits
        near = common * 1000 >= round(threshold * 1000) * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(near, False)
        if part.column("left")[0].as_py() != part.column("right")[0].as_py():
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        label = joined(len(ids), a, b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(ids[label]), pa.array((near * copies[None, :]).sum(1).astype(np.int64)),
             part.column("blocks").combine_chunks()], names=["node", "root", "links", "blocks"])


def n_blocks(rows: Column, block: tuple[int, int]) -> Column:
    """Into how many blocks a group of so many rows is cut."""
    fine, coarse = (F.ceil(rows / F.lit(size)) for size in block)
    return F.greatest(F.least(fine, F.lit(SPREAD)), coarse).cast("int")


def in_block_pairs(rows: DataFrame, key: str, blocks: str, block: str) -> DataFrame:
    """Each row once per pair of blocks (left <= right) of its group that its own block is part of."""
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return (
        rows.withColumn("__other", other)
        .withColumn("left", F.least(block, "__other")).withColumn("right", F.greatest(block, "__other")).drop("__other")
    )


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
            threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per document: id, class_id (least id of all that are linked to it, directly or through others),
    n_links (documents with a similarity of *threshold* or more, copies included) and n_copies (documents with the
    same words in the same order, itself included).

    A text of fewer than *words* words is one run. Texts without words (null, empty, punctuation only) are linked to
    nothing, each a class of its own. Rows that share an id are documents of their own; other columns are left out; an
    empty table gives no rows. Exact copies are taken together first, so their number costs nothing later; a group of
    near copies of any size is compared block by block.
    """
    length = prefix_length(threshold, trees, depth, recall)
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text")).withColumn(
        "row", F.xxhash64("id", "text"))
    signed = cut_lineage(signatures(source, trees, length, words), "signatures")
    texts = cut_lineage(
        signed.where("h1 is not null").groupBy("h1", "h2").agg(
            F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull(), "row"))["row"].alias("row"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
            F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"))
        .withColumn("text_id", F.monotonically_increasing_id()), "texts")

    # candidates: documents under the same node of a tree
    nodes = texts.select(F.explode("nodes").alias("node"), F.col("text_id").alias("id"))
    shared = cut_lineage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
    met = cut_lineage(nodes.join(shared, "node").withColumn("blocks", n_blocks(F.col("n"), NODE_BLOCK)).drop("n"), "met")
    met = met.join(texts.select(F.col("text_id").alias("id"), "sketch"), "id").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    n_bytes = len(range(0, trees * length, SKETCH_EVERY))
    least_equal = int(n_bytes * (threshold - SIGMAS * (threshold * (1 - threshold) / n_bytes) ** 0.5))
    edges = (
        in_block_pairs(met, "node", "blocks", "block").drop("block", "blocks")
        .repartition("node", "left", "right").sortWithinPartitions("node", "left", "right", "id")
        .mapInArrow(lambda batches: candidate_edges(batches, least_equal), "a long, b long")
    )
    grouped = cut_lineage(components(edges), "candidates")

    # exact verification within what is connected
    members = cut_lineage(
        grouped.withColumnRenamed("node", "text_id").join(
            texts.select("text_id", "row", "h1", "h2", "copies", "size"), "text_id"), "described")
    sizes = cut_lineage(
        members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("runs")).select(
            "component", F.greatest(n_blocks(F.col("n"), SET_BLOCK), F.least("n", F.ceil(F.col("runs") / F.lit(RUNS))).cast("int")).alias("blocks")),
        "sizes")
    members = cut_lineage(members.drop("size").join(sizes, "component"), "members")

    def sets(batches):
        hasher = SpanHasher()
        for batch in batches:
            own, out = [], []
            for i, (text, h1, h2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2")))):
                data = normal_bytes(text)
                if data and content_key(data) == (h1, h2):  # else another text under the same hash
                    own.append(i)
                    out.append(np.unique(shingle_hashes(hasher, data, words)).tobytes())
            kept = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in ("component", "text_id", "blocks", "copies")), pa.array(out, pa.binary())],
                names=["component", "node", "blocks", "copies", "shingles"])

    # most documents have no candidate: a bitmap of fixed size keeps their texts out of the shuffle
    near = bloom.marked(source, "row", bloom.bitmap(members, "row"), "__near").where("__near").select("id", "row", "text")

    def one_of_each(batches):
        seen = set()
        for batch in batches:
            own = zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())
            new = [i for i, (row, text) in enumerate(own) if (key := (row, hash(text))) not in seen and not seen.add(key)]
            yield batch.take(pa.array(new, pa.int64()))

    # equal rows, with an id or without: one of each goes on from a task, and one of all tasks to the verification; dealt by
    # row alone, the rows already lie as the join needs them
    near = near.select("row", "text")
    near = near.mapInArrow(one_of_each, near.schema).repartition("row").dropDuplicates(["row", "text"])
    known = near.join(members, "row").select("component", "text_id", "blocks", "copies", "text", "h1", "h2").mapInArrow(
        sets, "component long, node long, blocks int, copies long, shingles binary")
    pairs = in_block_pairs(
        known.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "component", "blocks", "block")
    checked = cut_lineage(
        pairs.repartition("component", "left", "right").sortWithinPartitions("component", "left", "right", "node")
        .mapInArrow(lambda batches: verified(batches, threshold), "node long, root long, links long, blocks int"), "checked")

    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    large = components(checked.where("blocks > 1").select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = cut_lineage(
        links.join(large, "node", "left").select(
            F.col("node").alias("text_id"), "links", F.coalesce("component", "root").alias("root")), "roots")
    named = texts.select("text_id", "id", "h1", "h2", "copies").join(rooted, "text_id", "left").select(
        "id", "h1", "h2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "text_id").alias("root"))
    named = cut_lineage(named, "named")
    least = cut_lineage(named.groupBy("root").agg(F.min("id").alias("class_id")), "least")
    named = cut_lineage(named.drop("id").join(least, "root").drop("root"), "classes")
    return signed.select("id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        F.col("id").alias(id_column),
        F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, text_column: str = "text", **parameters) -> DataFrame:
    """One document of each class, whole; rows that are equal in all columns are one document.

    A document is known by a 64-bit hash of its row, so null and repeated ids do no harm. Texts move only where the
    document may be one that goes.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.withColumn("__row", row)
    found = cut_lineage(classes(keyed, "__row", text_column, **parameters), "near-dups")
    repeated = cut_lineage(found.groupBy("__row", "class_id").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1 and __row = class_id").select("__row"), "repeated")
    gone = cut_lineage(found.where("__row <> class_id").select("__row").distinct().unionByName(repeated), "gone")
    seen = bloom.marked(keyed, "__row", bloom.bitmap(gone, "__row"), "__may_go")
    twice = bloom.marked(keyed, "__row", bloom.bitmap(repeated, "__row"), "__twice").where("__twice")
    return (
        seen.where("not __may_go").select(docs.columns)
        .unionByName(seen.where("__may_go").join(gone, "__row", "left_anti").select(docs.columns))
        .unionByName(twice.join(repeated, "__row", "left_semi").select(docs.columns).dropDuplicates())
    )
