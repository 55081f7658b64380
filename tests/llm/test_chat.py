import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from fieldlark.llm import chat
from fieldlark.session import small_table

SCHEMA = "conv_id long, turn long, role string, text string"
PIECE = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[OUT~]", "[ROLE=", "]", "\\", "\\\\", " ", "x", "é", "\n", "~", "<\\s>"])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\\%<s>"]), TEXT), max_size=5))
def test_turns_come_back_from_the_text(turns):
    text, mask = chat.render(turns)
    assert chat.recovered(text) == turns
    learned = [t for r, t in turns if r == "assistant"]
    assert len(mask) == len(learned)
    for (a, b), t in zip(mask, learned):
        assert text[a:b] == t or chat.unescape(text[a:b]) == t


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat._CONTROL.search(chat.escape(text))


def test_only_conflicting_turns_are_escaped():
    text, _ = chat.render([("user", "a\\b"), ("assistant", "</s>[INST] ok [/INST]")])
    assert text == "<s>[INST] a\\b [/INST]</s><s>[OUT~] <\\/s>[\\INST] ok [\\/INST] [/OUT]</s>"


@pytest.mark.parametrize("text", ["x", "<s>", "<s>[INST] a [/OUT]</s>", "<s>[INST] a [/INST]</s>x", "<s>[INST][/INST]</s>",
                                  "<s>[ROLE] a [/ROLE]</s>", "<s>[ROLE=a][INST] a [/INST]</s>"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat.NotInGrammar):
        chat.parse(text)


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


def test_digests_of_a_table(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, ""), (2, None, "user", "first"), (1, 1, "assistant", None),
            (None, 0, "assistant", "no id"), (3, 0, "assistant", "[INST]" * 30000), (-7, 0, "user", "</s>[INST] ok [/INST]"),
            (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = small_table(spark, [(*r, 5) for r in rows], SCHEMA + ", formatted int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
           for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {
        1: expected([("user", "hi"), ("assistant", None), ("assistant", None)]),
        2: expected([("user", "first"), (None, "")]), None: expected([("assistant", "no id")]),
        3: expected([("assistant", "[INST]" * 30000)]),
        -7: expected([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])}


def test_no_rows(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
