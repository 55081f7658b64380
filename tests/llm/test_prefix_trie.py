from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldlark.llm.prefix_trie import TernaryTree, conversation_trie, encode_turns, median_first, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rest(c):  # as Java and SQL divide
    return c - 20 * int(c / 20)


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out.append((c, [*own.get(c - rest(c), [])[:h], *turns[h:]]))
    return out


def brute(lists, words):
    """The rows of the trie of (conv_id, sequence) pairs; *words* of the last element."""
    members = defaultdict(list)
    for c, seq in lists:
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * words(p[-1]) if p else 0
    first = {p: min(c for c, _ in who) for p, who in members.items()}
    return Counter(
        (first[p], len(p), first[p[:-1]] if p else None, len(who), children[p], leaves[p], saved[p],
         sha(",".join(str(c) for c, ends in sorted(who) if ends))) for p, who in members.items())


def word_count(turn):
    return len(re.findall(r"[^\x20\x09-\x0D]+", turn[1]))


CASES = {
    "empty": [],
    "null ids": [(None, 0, "user", "a"), (None, None, None, None)],
    "one": [(5, 0, "user", "a b c")],
    "turnless": [(1, 0, "user", "one turn only"), (2, 0, "user", "one"), (4, 0, "user", "x")],
    "nulls, ties, repeated rows": [(20, None, None, None), (20, 1, "user", None), (20, 1, "user", "b"), (20, 1, "user", "b"),
                                   (21, 3, None, "b"), (21, None, "a", "b"), (21, 3, "", "b"), (-7, 0, "user", "x"), (-20, 0, "user", "y z")],
    "missing base": [(c, t, "user", f"t{t}") for c in (41, 42, 43, 44, 61) for t in range(5)],
    "roles and texts do not run together": [(1, t, r, x) for t, (r, x) in enumerate([("a", "bc"), ("ab", "c"), ("", "abc"), ("abc", "")])],
    "long": [(0, t, "user", f"{t % 7} w") for t in range(3000)] + [(1, t, "user", f"{t % 7} w") for t in range(2500)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows = CASES[name]
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == brute(sequences(rows), word_count)


def random_lists(seed, n, alphabet, depth):
    draw = random.Random(seed)
    return [(i, [draw.randrange(alphabet) for _ in range(draw.randrange(depth))]) for i in draw.sample(range(10 * n), n)]


@pytest.mark.parametrize("turns_a_tree", [1, 7, 40, 10_000])
@pytest.mark.parametrize("lists", [
    random_lists(1, 60, 2, 7), random_lists(2, 80, 30, 4),
    [(i, [4, 5, 6]) for i in range(30)] + [(90 + i, [4, 5, 6, i]) for i in range(9)] + [(70, [4, 5]), (71, []), (72, [])],
    [(i, [1] * i) for i in range(14)], [(0, [])], [(9, []), (3, [])],
], ids=["narrow", "wide", "copies", "chain", "one", "turnless"])
def test_any_cut_into_trees_gives_the_same_rows(spark, lists, turns_a_tree):
    df = spark.createDataFrame([(c, s, [t + 2 for t in s]) for c, s in lists], "conv_id long, ids array<long>, words array<long>")
    assert Counter(tuple(r) for r in trie(df, turns_a_tree).collect()) == brute(lists, lambda t: t + 2)


def test_many_range_shards(spark):
    lists = random_lists(3, 300, 3, 8) + [(10_000 + i, [1, 1, 2]) for i in range(200)]
    df = spark.createDataFrame([(c, s, [1] * len(s)) for c, s in lists], "conv_id long, ids array<long>, words array<long>")
    keys = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, value in keys.items():
            spark.conf.set(k, value)
        got = Counter(tuple(r) for r in trie(df).collect())
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert got == brute(lists, lambda t: 1)


def test_other_columns_and_clashing_names(spark):
    rows = [(c, t, "user", f"a {t}") for c in range(5) for t in range(3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos int, digest string")
    assert Counter(tuple(r) for r in conversation_trie(df).collect()) == brute(sequences(rows), word_count)


def test_rebuilt_heads(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (40, 41, 42, 43) for t in range(2)]
    got = {r[0]: len(r[1]) for r in rebuilt(encode_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {c: len(seq) for c, seq in sequences(rows)}


def test_median_insertion_keeps_the_tree_flat():
    n = 1000
    assert sorted(median_first(n)) == list(range(n))
    tree = TernaryTree()
    for i in median_first(n):
        tree.insert([i], [1])
    depth = {tree.equal[0]: 1}
    for node in range(1, n + 1):
        for link in (tree.less[node], tree.more[node]):
            if link:
                depth[link] = depth[node] + 1
    assert len(depth) == n and max(depth.values()) <= 10
