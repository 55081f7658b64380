import random

import pytest

from fieldlark.llm import contamination
from fieldlark.session import small_table
from tests.llm.test_words import words


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), {}
        for item, itext in items:
            t = words(itext)
            if not t:
                continue
            n = min(window, len(t))
            for p in range(len(t) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == t[p:p + n]:
                        hit.update(range(i, i + n))
                        long = n
                        while i + long < len(w) and p + long < len(t) and w[i + long] == t[p + long]:
                            long += 1
                        key = item or ""
                        found[key] = min(found.get(key, (0,)), (-long, i, p))
        out.append((doc_id, len(w), len(hit), sorted(found), [found[k] for k in sorted(found)]))
    return sorted(out, key=repr)


def data():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß"]
    items = [(str(i), " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 4, 9, 10, 11, 40, 60])))) for i in range(3, 14)]
    items += [("z", None), (None, "alone here"), ("dup", items[5][1]), ("3", "another text of that id"), ("e", " ... ")]
    docs = []
    for i in range(60):
        w = draw.choices([f"v{k}" for k in range(30)] + vocabulary[:3], k=draw.randrange(0, 60))
        if i % 3 == 0:
            t = words(draw.choice(items)[1]) * 2
            a = draw.randrange(0, max(len(t), 1))
            w[5:5] = t[a: a + draw.randrange(1, 50)]
        docs.append((i, " ".join(w).title()))
    docs += [(100, None), (101, ""), (102, "!!"), (0, docs[0][1]), (103, items[6][1] + " " + items[7][1]), (None, "alone, HERE")]
    return docs, items


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_same_as_brute_force(spark, block_words):
    docs, items = data()
    df = small_table(spark, [(*d, "x") for d in docs], "doc_id long, text string, items string")
    bench = small_table(spark, items, "item_id string, text string")
    got = contamination.find(df, bench, block_words=block_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]),
                    [(-a, b, c) for a, b, c in zip(r.match_words, r.match_at, r.match_item_at)]) for r in got), key=repr) == brute(docs, items)
    assert all(r.n_items == len(r["items"]) for r in got)


def test_matches_beyond_the_sorting_depth(spark):
    long = " ".join(f"u{i}" for i in range(200))
    df = small_table(spark, [(1, "a b " + long + " c"), (2, "filler " * 30000)], "doc_id long, text string")
    bench = small_table(spark, [(7, "x " + long + " y")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.find(df, bench).collect()}
    assert (got[1].n_hit, got[1].match_words, got[1].match_at, got[1].match_item_at) == (200, [200], [2], [1])
    assert got[2].n_words == 30000 and got[2].n_hit == 0


def test_empty_tables(spark):
    docs = small_table(spark, [(1, "some words")], "doc_id long, text string")
    bench = small_table(spark, [(7, "some words")], "item_id long, text string")
    assert contamination.find(docs.limit(0), bench).collect() == []
    assert contamination.find(docs, bench.limit(0)).collect()[0].n_hit == 0
    assert contamination.find(docs, bench).collect()[0].n_hit == 2


def test_blocks_are_counted_in_words_not_in_blanks(spark, monkeypatch):
    sent = []
    real = contamination.test_set
    monkeypatch.setattr(contamination, "test_set", lambda block, window: sent.append(len(block)) or real(block, window))
    items = [(f"i{k}", "\n-".join(f"w{k}x{j}" for j in range(100))) for k in range(40)] + [("same", "a-b-c")] * 500
    df = small_table(spark, [(1, "so " + " ".join(f"w3x{j}" for j in range(50))), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination.find(df, small_table(spark, items, "item_id string, text string"), block_words=1000).collect()}
    assert (got[1].n_hit, got[1]["items"], got[2].n_hit, got[2]["items"]) == (50, ["i3"], 3, ["same"])
    assert len(sent) == 5 and sum(sent) == 41
