"""Prefix trie of conversations: what many of them begin with, and the tokens a shared prefix saves.

Turns are encoded by a dictionary, so a conversation is a short list of numbers.
The lists are dealt out by ranges in their own order; every shard holds a run of
the sorted lists and builds a ternary search tree of it, inserting the median first.
One pass over the nodes from the last to the first accumulates members, leaves and
savings. A node on the first or last path of a shard that the neighbouring shard has
too is a boundary node. Each shard gives its part of it, so arranged that parts add
up: the first shard that holds a node counts its words and counts it as a child, the
last one that holds a conversation's end decides whether it is a leaf.

A range splits a popular prefix, and a popular conversation too, over as many shards
as it needs. Inside a task a shard is cut again at a fixed number of turns, so the
memory of a tree is bounded. What has to be in one place is one conversation: eight
bytes a turn.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.llm.ranks import POS, ranked
from fieldlark.operators.joins import spread_join
from fieldlark.session import cut_lineage

TURNS_A_TREE = 1 << 18
BASE_EVERY, MOST_HEAD = 20, 3
BEFORE, OWN, BEHIND = -1, 0, 1
NOBODY = (1 << 63) - 1
NODE_SCHEMA = (
    "shard long, part long, boundary boolean, key binary, parent_key binary, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, chunk string")
NODE_ARROW = pa.schema([
    ("shard", pa.int64()), ("part", pa.int64()), ("boundary", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("chunk", pa.string())])
NO_ENDS = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """Ternary search tree of lists of numbers; node 0 is the empty prefix. A node is made after its parent."""

    def __init__(self) -> None:
        self.token, self.less, self.equal, self.more = (array("q", [0]) for _ in range(4))
        self.parent, self.words = array("q", [-1]), array("q", [0])

    def _new(self, token: int, words: int, parent: int) -> int:
        for column, value in ((self.token, token), (self.less, 0), (self.equal, 0), (self.more, 0),
                              (self.parent, parent), (self.words, words)):
            column.append(value)
        return len(self.token) - 1

    def insert(self, ids: list[int], words: list[int]) -> int:
        """The node of the whole list; the nodes of its prefixes are made where they are missing."""
        token, less, equal, more, at = self.token, self.less, self.equal, self.more, 0
        for t, w in zip(ids, words):
            links, place = equal, at
            while node := links[place]:
                if t == token[node]:
                    break
                links, place = (less if t < token[node] else more), node
            else:
                node = links[place] = self._new(t, w, at)
            at = node
        return at

    def path(self, node: int) -> list[int]:
        """The nodes from the root down to *node*."""
        nodes = []
        while node >= 0:
            nodes.append(node)
            node = self.parent[node]
        return nodes[::-1]


def median_first(n: int) -> Iterator[int]:
    """0 to n-1, the median of each stretch before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            todo += [(middle + 1, b), (a, middle)]


def common(a: list[int], b: list[int]) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def begins_with(whole: list[int], start: list[int]) -> bool:
    return whole[:len(start)] == start


def prefix_keys(ids: list[int]) -> list[bytes]:
    """128-bit keys of all prefixes of a list, the empty one first."""
    keys = [b""]
    for t in ids:
        keys.append(hashlib.blake2b(keys[-1] + t.to_bytes(8, "little", signed=True), digest_size=16).digest())
    return keys


def tree_nodes(shard: int, part: int, before: list[int] | None, rows: list[tuple], behind: list[int] | None) -> list[tuple]:
    """The nodes of one sorted run of (ids, words, conv_id) rows, as rows of NODE_SCHEMA.

    *before* and *behind* are the lists next to the run, if any.
    """
    lists: list[tuple[list[int], list[int], list[int]]] = []  # different lists and who has them
    for ids, words, conv in rows:
        if lists and lists[-1][0] == ids:
            lists[-1][2].append(conv)
        else:
            lists.append((ids, words, [conv]))
    tree, ends = TernaryTree(), [0] * len(lists)
    for i in median_first(len(lists)):
        ends[i] = tree.insert(lists[i][0], lists[i][1])

    n = len(tree.token)
    members, children, leaves, gross, net = (array("q", bytes(8 * n)) for _ in range(5))
    first_conv, owned = array("q", [NOBODY]) * n, bytearray(b"\1") * n
    keys: dict[int, bytes] = {}  # of boundary nodes
    for ids, end, other in ((lists[0][0], ends[0], before), (lists[-1][0], ends[-1], behind)):
        if other is not None:
            shared = common(ids, other) + 1
            for node, key in zip(tree.path(end)[:shared], prefix_keys(ids[:shared - 1])):
                keys[node] = key
                if other is before:
                    owned[node] = 0
    followers = [ids for ids, _, _ in lists[1:]] + [behind]
    convs_of = {}
    for (ids, _, convs), end, follower in zip(lists, ends, followers):
        members[end], first_conv[end], convs_of[end] = len(convs), convs[0], convs
        leaves[end] = follower is None or not begins_with(follower, ids)

    parent, words = tree.parent, tree.words
    for i in range(n - 1, 0, -1):  # a node comes after its parent, so all below it is done
        p = parent[i]
        gross[i] += members[i] * words[i]
        net[i] += owned[i] * words[i]
        members[p] += members[i]
        children[p] += owned[i]
        leaves[p] += leaves[i]
        gross[p] += gross[i]
        net[p] += net[i]
        if first_conv[i] < first_conv[p]:
            first_conv[p] = first_conv[i]

    out, depth = [], array("q", bytes(8 * n))
    for i in range(n):
        p = parent[i]
        depth[i] = depth[p] + 1 if p >= 0 else 0
        chunk = ",".join(map(str, convs_of[i])) if i in convs_of else None
        known = p >= 0 and p not in keys
        ends_of = None if i in keys else hashlib.sha256(chunk.encode()).hexdigest() if chunk else NO_ENDS
        out.append((
            shard, part, i in keys, keys.get(i), keys.get(p), depth[i], first_conv[i], first_conv[p] if known else None,
            members[i], children[i], leaves[i], gross[i] - net[i], ends_of, chunk if i in keys else None))
    return out


def runs(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[tuple]:
    """Arguments of ``tree_nodes`` from sorted rows: a shard after the other, each cut where it exceeds *turns*."""
    shard, part, before, rows, size = None, 0, None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "ids", "words", "conv_id")]
        for at, kind, ids, words, conv in zip(*columns):
            if at != shard:
                if rows:
                    yield shard, part, before, rows, None
                shard, part, before, rows, size = at, 0, None, [], 0
            if kind == BEFORE:
                before = ids
            elif kind == BEHIND:
                yield shard, part, before, rows, ids
                rows = []
            else:
                if size > turns:
                    yield shard, part, before, rows, ids
                    part, before, rows, size = part + 1, rows[-1][0], [], 0
                rows.append((ids, words, conv))
                size += len(ids) + 1
    if rows:
        yield shard, part, before, rows, None


def in_batches(rows: list[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), size):
        columns = list(zip(*rows[a:a + size]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def encode_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, turn_id, words) of (conv_id, turn, role, text) rows.

    Turns stand in the order of ``turn``, null first; rows of equal ``turn`` follow by the SHA-256 of role and text, so
    repeated rows are turns of their own. Null roles and texts count as empty. A ``turn_id`` stands for one (role,
    text). Rows without a conv_id belong to no conversation and take no part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    placed = ranked(rows, F.col("conv_id"), [F.col("turn"), F.col("digest")], "turns")
    placed = cut_lineage(placed.select("conv_id", F.col(POS).alias("pos"), "digest", "words"), "turns")
    dictionary = cut_lineage(
        placed.select("digest").distinct().withColumn("turn_id", F.monotonically_increasing_id()), "turn-ids")
    return cut_lineage(spread_join(placed, dictionary, "digest").select("conv_id", "pos", "turn_id", "words"), "turns")


def head_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_HEAD + 1))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): every conversation of ``encode_turns`` with its head replaced by that of its base.

    The first h turns of conversation c - c % 20 (fewer if it has fewer, none if there is no such), then the turns of c
    behind its first h; h is the CRC-32 of the decimal c, modulo 4. A conversation may end up without a turn.
    """
    turn = F.struct("part", "pos", "turn_id", "words").alias("turn")
    convs = turns.select("conv_id").distinct()
    heads = turns.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("pos") < MOST_HEAD)).select(
        F.col("conv_id").alias("base"), "pos", "turn_id", "words", F.lit(0).alias("part"))
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE_EVERY).join(heads, "base").where(
        F.col("pos") < head_length(F.col("conv_id"))).select("conv_id", turn)
    own = turns.where(F.col("pos") >= head_length(F.col("conv_id"))).withColumn("part", F.lit(1)).select("conv_id", turn)
    present = convs.withColumn("turn", F.lit(None).cast(own.schema["turn"].dataType))
    whole = taken.unionByName(own).unionByName(present).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("all"))
    return whole.select(
        "conv_id", F.transform("all", lambda t: t["turn_id"]).alias("ids"), F.transform("all", lambda t: t["words"]).alias("words"))


def trie(lists: DataFrame, turns_a_tree: int = TURNS_A_TREE) -> DataFrame:
    """One row per prefix of the (conv_id, ids, words) rows, the empty one included.

    conv_id is the smallest of those that begin with the prefix, n_convs their number; ends_sha256 is the hash of the
    ascending, comma-joined decimal conv_ids of those that are the prefix. Rows are conversations of their own, so a
    repeated conv_id counts as often as it stands. An empty table gives no rows.
    """
    dealt = cut_lineage(
        lists.repartitionByRange("ids", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")), "trie-lists")
    by_shard = Window.orderBy("shard")  # two lists a shard, whatever the number of conversations
    edges = dealt.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last")).select(
        "shard", F.lag("last").over(by_shard).alias("before"), F.lead("first").over(by_shard).alias("behind"))
    edges = cut_lineage(edges, "trie-edges")

    def side(column: str, kind: int) -> DataFrame:
        return edges.where(F.col(column).isNotNull()).select(
            "shard", F.lit(kind).alias("kind"), F.col(column).alias("ids"),
            F.lit(None).cast("array<long>").alias("words"), F.lit(None).cast("long").alias("conv_id"))

    def build(batches):
        for run in runs(batches, turns_a_tree):
            yield from in_batches(tree_nodes(*run), NODE_ARROW)

    own = dealt.select("shard", F.lit(OWN).alias("kind"), "ids", "words", "conv_id")
    rows = own.unionByName(side("before", BEFORE)).unionByName(side("behind", BEHIND))
    nodes = cut_lineage(
        rows.repartitionByRange("shard").sortWithinPartitions("shard", "kind", "ids", "conv_id")
        .mapInArrow(build, NODE_SCHEMA), "trie-nodes")
    return merged(nodes)


def hashed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of sorted (key, chunk) rows: the hash of each key's chunks, comma-joined, one chunk at a time."""
    schema, key, state = pa.schema([("key", pa.binary()), ("ends", pa.string())]), None, None
    for batch in batches:
        for at, chunk in zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist()):
            if state is not None and at == key:
                state.update(b"," + chunk.encode())
                continue
            if state is not None:
                yield from in_batches([(key, state.hexdigest())], schema)
            key, state = at, hashlib.sha256(chunk.encode())
    if state is not None:
        yield from in_batches([(key, state.hexdigest())], schema)


def merged(nodes: DataFrame) -> DataFrame:
    """The nodes of all shards; the parts of boundary nodes are added up."""
    parts = nodes.where("boundary")
    ends = (
        parts.where("chunk is not null").select("key", "shard", "part", "chunk")
        .repartition("key").sortWithinPartitions("key", "shard", "part")
        .mapInArrow(hashed_chunks, "key binary, ends string"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = cut_lineage(
        parts.groupBy("key").agg(
            F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
        .join(ends, "key", "left"), "trie-boundary")
    conv_of = shared.select("key", F.col("conv_id").alias("conv_of"))
    # by shard, not by prefix alone: half of all nodes may be children of one prefix
    here = parts.select("shard", "part", "key").join(conv_of, "key")
    below = spread_join(
        nodes.where("not boundary and parent_key is not null").drop("parent_conv_id", "key").withColumnRenamed("parent_key", "key"),
        here, ["shard", "part", "key"]).withColumnRenamed("conv_of", "parent_conv_id")
    inside = nodes.where("not boundary and parent_key is null")
    top = shared.join(conv_of.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumnRenamed(
        "conv_of", "parent_conv_id")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = inside.select(names).unionByName(below.select(names)).unionByName(top.select(names))
    return every.select(*names[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt on the heads of their bases; see ``encode_turns``, ``rebuilt`` and ``trie``."""
    return trie(rebuilt(encode_turns(conversations)))
