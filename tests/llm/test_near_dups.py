import random
from collections import Counter

import numpy as np
import pytest

from fieldlark.llm import near_dups
from fieldlark.session import small_table
from tests.llm.test_words import words

SCHEMA = "doc_id long, text string, lang string, class_id string, n_chars long"


def brute(rows):
    """(id, class, links, copies) by comparing all pairs of documents."""
    sets, order = [], []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
        order.append(tuple(w))
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in link[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[label[i]] = min(least.get(label[i], 10**18), rows[i][0])
    copies = Counter(order)
    return sorted(((rows[i][0], least.get(label[i]), len(link[i]), copies[order[i]] if order[i] else 1) for i in range(n)), key=repr)


def data():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = draw.choices(vocabulary, k=60)
    rows = []
    for i in range(60):
        base = draw.choices(vocabulary, k=draw.choice([3, 5, 8, 40, 120]))
        if i % 4 == 0:
            base += passage
        rows.append(base)
        for _ in range(draw.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(draw.randrange(0, 4)):
                near[draw.randrange(len(near))] = draw.choice(vocabulary)
            rows.append(near)
    base = draw.choices(vocabulary, k=150)  # one large group of near copies
    for _ in range(150):
        near = list(base)
        near[draw.randrange(150)] = draw.choice(vocabulary)
        rows.append(near)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    draw.shuffle(rows)
    rows += [(1000 + i, rows[7][1].upper() + " !") for i in range(40)]  # copies by words
    rows += [(2000, None), (2001, ""), (2002, None), (2003, "?!"), (2004, "?!"), (2005, "one"), (2006, "One."), (2007, "one two")]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, "nobody knows this text at all today"),
             (None, "nobody knows this text at all today")]
    return rows


def test_same_as_all_pairs(spark):
    rows = data()
    df = small_table(spark, [(i, t, "en", "x", 3) for i, t in rows], SCHEMA)
    got = near_dups.classes(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=repr) == brute(rows)


def test_one_of_each_group_is_kept(spark):
    rows = data()
    df = small_table(spark, [(i, t, "en", None, 3) for i, t in rows], SCHEMA)
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns
    expected = brute(rows)
    n_null_or_empty = sum(1 for _, t in rows if not words(t))
    with_words = [(i, t) for i, t in rows if words(t)]
    n_classes = len({c[1] for c in brute([(k, t) for k, (_, t) in enumerate(with_words)])})
    distinct_wordless = len({(i, t) for i, t in rows if not words(t)})
    assert n_null_or_empty == 5 and len(expected) == len(rows)
    assert kept.count() == n_classes + distinct_wordless


def test_empty_and_single(spark):
    df = small_table(spark, [(1, "a b c d e f", "en", None, 3)], SCHEMA)
    assert near_dups.classes(df.limit(0)).collect() == []
    assert near_dups.keep_one(df.limit(0)).collect() == []
    assert [tuple(r) for r in near_dups.classes(df).collect()] == [(1, 1, 0, 1)]


def test_prefixes_shorten_until_the_recall_is_met():
    assert near_dups.prefix_length(0.8, 40, 10, 0.5) > near_dups.prefix_length(0.8, 40, 10, 0.99999)
    k = near_dups.prefix_length()
    assert 1 - (1 - 0.8**k) ** near_dups.TREES >= near_dups.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** near_dups.TREES


def test_minhashes_estimate_the_similarity():
    draw = np.random.Generator(np.random.PCG64(1))
    signer = near_dups.Signer(40, 6)
    for share in (0.5, 0.8, 0.95):
        common = draw.integers(0, 2**63, 2000, dtype=np.uint64)
        own = [draw.integers(0, 2**63, int(2000 * (1 / share - 1) / 2), dtype=np.uint64) for _ in range(2)]
        a, b = (signer.minhashes(np.concatenate([common, x])) for x in own)
        assert abs((a == b).mean() - share) < 0.1


@pytest.mark.parametrize("seed", range(5))
def test_overlaps(seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    sets = [np.unique(draw.integers(0, 9000, draw.integers(1, 6000)).astype(np.uint64)) for _ in range(7)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near_dups.overlaps(sets).astype(int).tolist() == want


def test_near_copies_without_an_id_are_linked(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[8 * k: 8 * k + 120]) for k in range(4)]  # each is near the next one only
    rows = [(5, chain[0]), (None, chain[1]), (None, chain[1]), (7, chain[2]), (None, chain[3]), (None, chain[3].upper()), (None, None),
            (None, " ".join(base[150:])), (None, " ".join(base[151:]))]
    df = small_table(spark, rows, "doc_id long, text string")
    want = brute(rows)
    assert {r[1:3] for r in want} >= {(5, 2), (5, 3)}
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in near_dups.classes(df).collect()]
    assert sorted(got, key=repr) == want


def test_repeated_rows_reach_the_verification_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 3000 + [(2, text + " more")]
    df = small_table(spark, rows, "doc_id long, text string").repartition(8)
    seen = []
    real = near_dups.in_block_pairs
    monkeypatch.setattr(near_dups, "in_block_pairs", lambda df, key, *names: seen.append((key, df)) or real(df, key, *names))
    got = {tuple(r) for r in near_dups.classes(df).collect()}
    assert got == {(1, 1, 3000, 3000), (2, 1, 3000, 1)}
    assert [d.count() for key, d in seen if key == "component"] == [2]
