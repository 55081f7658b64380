import re

import numpy as np
from hypothesis import given, settings, strategies as st

from fieldlark.llm.words import SpanHasher, normal_bytes, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_words_are_those_of_the_pattern(text):
    assert normal_bytes(text).decode().split(" ") == (words(text) or [""])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "ba", "é"]), max_size=12))
def test_equal_runs_have_equal_hashes(tokens):
    hasher = SpanHasher()
    data = " ".join(tokens).encode()
    single = word_hashes(hasher, data)
    assert len(single) == len(tokens)
    assert len(set(single)) == len(set(tokens))
    runs = shingle_hashes(hasher, data, 3)
    expected = [tuple(tokens[i:i + 3]) for i in range(max(len(tokens) - 2, 1))] if tokens else []
    assert len(runs) == len(expected)
    assert len(np.unique(runs)) == len(set(expected))
    assert runs.tolist() == shingle_hashes(SpanHasher(), data, 3).tolist()


def test_nothing_has_no_words():
    for text in (None, "", " .,;\n"):
        assert normal_bytes(text) == b""
        assert len(shingle_hashes(SpanHasher(), normal_bytes(text), 5)) == 0
