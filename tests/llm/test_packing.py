import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from fieldlark.llm import packing
from fieldlark.llm.queries import vocabulary
from fieldlark.session import small_table


def naive(lengths, capacity):
    """Best fit decreasing, item by item: remaining capacities of the bins."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)


def laid_out(counts, capacity):
    rules, bins = packing.best_fit_decreasing(counts, capacity)
    places, ranks = defaultdict(list), defaultdict(list)
    for r in rules:
        ranks[r.length] += range(r.first, r.first + r.count)
        for k in range(r.count):
            places[r.bin + k // r.per_bin].append((r.offset + k % r.per_bin * r.length, r.length))
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    return places, bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 23), max_size=120))
def test_same_bins_as_item_by_item(lengths):
    places, bins = laid_out(Counter(lengths), 23)
    assert sorted(places) == list(range(bins))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 23
    assert sorted(23 - sum(n for _, n in own) for own in places.values()) == naive(lengths, 23)


def test_many_items_take_few_rules():
    counts = {n: 10**9 + n for n in range(1, 4097)}
    rules, bins = packing.best_fit_decreasing(counts)
    assert len(rules) < 50_000
    total = sum(n * c for n, c in counts.items())
    assert total / 4096 <= bins <= 1.001 * total / 4096 + 1


def test_tightest_finds_the_least_open_capacity():
    tree = packing.Tightest(100)
    for c in (3, 50, 100):
        tree.set(c, True)
    assert [tree.find(n) for n in (1, 3, 4, 50, 51, 100)] == [3, 3, 50, 50, 100, 100]
    tree.set(100, False)
    assert tree.find(51) is None and tree.find(100) is None


TEXTS = [None, "", " \n ", "Hello, World's end!  it's 2024", "GROSSE Straße ÉÈ à la\tfin\r\nok", "<|endoftext|> x <|ENDOFTEXT|>",
         "İstanbul ẖ H̱ Σίσυφος ΣΑΣ Å ́a", "日本語 テキスト 😀😀", "a b c\x1cd\x85e", "same text", "same text",
         "word " * 9000, "x" * 6000, "İı ŉ ǆ Ǆ"]


def test_pieces_hold_the_ids_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    df = small_table(spark, [(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    got = packing.pack(df.repartition(3), vocabulary(), keep_ids=True).collect()
    per_doc, per_bin = defaultdict(list), defaultdict(list)
    for r in got:
        per_doc[r.doc_id].append(r)
        per_bin[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in enumerate(TEXTS):
        own = sorted(per_doc[i], key=lambda r: r.piece)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids, text
        assert [r.start for r in own] == list(range(0, len(ids), 4096)) and [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 4096 for r in own[:-1])
    for own in per_bin.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    lengths = [r.length for r in got]
    assert len(per_bin) == len(naive(lengths, 4096))


def test_empty_table_and_other_keys(spark):
    df = small_table(spark, [("a", "x y", 1), (None, "x y", 1)], "name string, body string, piece int")
    got = packing.pack(df, vocabulary(), "name", "body").collect()
    assert sorted((r.name or "", r.length) for r in got) == [("", 3), ("a", 3)] and len({(r.sequence_id, r.offset) for r in got}) == 2
    assert packing.pack(df.limit(0), vocabulary(), "name", "body").collect() == []


def test_words_go_to_the_model_once(monkeypatch):
    """Words leave out the normalisation, and the most frequent ones outlive the bound of what is remembered."""
    monkeypatch.setattr(packing, "CACHE", 20)
    chunk_ids, plain, words = packing.ChunkIds(vocabulary()), [], []
    whole, of_words = chunk_ids.encode, chunk_ids.encode_words
    monkeypatch.setattr(chunk_ids, "encode", lambda some, **how: (plain.extend(some), whole(some, **how))[1])
    monkeypatch.setattr(chunk_ids, "encode_words", lambda some, **how: (words.extend(some), of_words(some, **how))[1])
    texts = [f"the Straße {'abcdefghij'[i]}x {'abcdefghij'[i]}éy of{'xyz'[i % 3]}, ÀÉĐŸ ſŉªº" for i in range(10)] + ["<|x THE ÀÉĐŸ 汉字"]
    got = [np.frombuffer(next(chunk_ids.of([text])), "<u4").tolist() for text in texts]
    assert got == [chunk_ids.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert Counter(w for line in words for w in line.split())["straße"] == 1
    assert not [t for t in plain if t in ("the", "straße")]
