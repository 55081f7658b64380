import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest
from hypothesis import given, settings, strategies as st

from fieldlark.llm import secrets
from fieldlark.session import small_table

SECRET = "password: hunter2hunter2"


def brute(text):
    """The patterns as they are asked for, failing matches dropped."""
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
                         r"[Kk][Ee][Yy]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".replace("[Kk][Ee][Yy]|[Aa]", "[Aa]"), text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


PIECE = st.sampled_from(["password", "TOKEN", "secret", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abcdef", "abc", "AKIA",
                         "ABCDEFGH01234567", "0123456789abcdef", "aſ", "K", "é", "\n", "/", "%"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert secrets.base_spans(text) == brute(text)
    assert set(brute(text)) <= set(secrets.all_spans(text)[0])


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize("wrapped", [
    quote(SECRET, safe=""), "".join(f"%{b:02X}" for b in SECRET.encode()), "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "".join(f"\\x{ord(c):02x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET), b64(SECRET),
    base64.urlsafe_b64encode(SECRET.encode()).decode().rstrip("="), b64(b64(SECRET)), b64(gzip.compress(SECRET.encode())),
    b64(zlib.compress(SECRET.encode())), b64(gzip.compress(b64(quote(SECRET)).encode())), quote(b64(SECRET), safe=""),
    b64("".join(f"\\u{ord(c):04x}" for c in b64(SECRET)))])
def test_wrapped_secrets_have_a_span_in_the_text(wrapped):
    text = f"Größe und «Mehr» {wrapped} the end"
    spans, oversize = secrets.all_spans(text)
    a = text.index(wrapped)
    inside = [s for s in spans if s[0] == "assign"]
    assert inside and not oversize
    for _, start, end in inside:
        assert a <= start < end <= a + len(wrapped)
    left = secrets.masked(text)
    assert secrets.all_spans(left)[0] == [] and left.startswith("Größe und «Mehr» ") and left.endswith(" the end")


def test_span_of_a_part_of_an_encoded_text():
    text = "x%20token%3Dabc%64efgh tail"
    assert ("assign", text.index("token"), text.index(" tail")) in secrets.all_spans(text)[0]


def test_clean_texts_stay():
    for text in ("", "plain words", "100%25 sure", "averyveryverylongwordwithoutanything", "a\\u00e9b", "see aHR0cDovL2V4YW1wbGUuY29t"):
        assert secrets.masked(text) == text and secrets.all_spans(text) == ([], [])


def test_layers_that_repeat_end():
    inner = "%2541" * 50
    assert secrets.all_spans(inner * 3)[0] == []
    deep = SECRET
    for _ in range(12):
        deep = b64(deep)
    assert secrets.all_spans(deep)[0] == [("assign", 0, len(deep))]


def test_oversize_layers_are_reported(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1000)
    token = b64(zlib.compress(b"a" * 100000))
    assert secrets.all_spans("x " + token)[1] == [(2, 2 + len(token))]


def test_tables(spark):
    texts = [None, "", "token=abcdefgh", "token=abcdefgh", "w " * 100000 + "AKIA" + "A" * 16]
    df = small_table(spark, [(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.find(df).collect()}
    assert [got[i].n_assign for i in range(5)] == [0, 0, 1, 1, 0] and got[4].n_access == 1
    assert [got[i].spans for i in range(5)] == ["", "", "assign:0:14", "assign:0:14", "access:200000:200020"]
    assert secrets.find(df).columns == ["doc_id", "text", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "oversize"]
    assert [r.text for r in secrets.remove(df).orderBy("doc_id").collect()][:3] == [None, "", secrets.MASK]
    assert secrets.find(df.limit(0)).collect() == [] and secrets.remove(df.limit(0)).collect() == []


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: gzip.compress(gzip.compress(x))])
def test_large_layers_are_read_to_the_end(monkeypatch, pack):
    monkeypatch.setattr(secrets, "MAX_LAYER", 2000)
    draw = random.Random(3)
    lines = ["".join(draw.choices("bcdfg hjkl", k=60)) + "." for _ in range(400)]
    token = b64(pack("\n".join([*lines, b64(SECRET), *lines, "AKIA" + "Z" * 16]).encode()))
    spans, oversize = secrets.all_spans("x " + token + " y")
    assert {(k, 2, 2 + len(token)) for k in ("assign", "access")} <= set(spans) and not oversize
    assert secrets.masked("x " + token + " y") == f"x {secrets.MASK} y"


def test_what_cannot_be_read_is_masked_and_spoils_nothing_else(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1000)
    bomb = "".join(f"%{b:02x}" for b in zlib.compress(b"z" * 100000))
    text = f"{bomb} and {quote(SECRET, safe='')} end"
    spans, oversize = secrets.all_spans(text)
    assert [s[0] for s in spans] == ["assign"] and oversize == [(0, len(bomb))]
    assert secrets.masked(text) == f"{secrets.MASK} and {secrets.MASK} end"


LONG = "some words before it, so that it is long enough to wrap: "


@pytest.mark.parametrize("wrapped", [
    base64.encodebytes((LONG[:45] + SECRET + " " + LONG * 3).encode()).decode().strip(),
    base64.encodebytes(gzip.compress((LONG + SECRET + "".join(map(chr, range(32, 126)))).encode())).decode().strip().replace("\n", "\r\n"),
    b64(gzip.compress(b"first one\n") + gzip.compress(SECRET.encode())), b64(bz2.compress(b"first") + bz2.compress(SECRET.encode())),
    b64(lzma.compress(b"first") + lzma.compress(SECRET.encode())),
    b64(b"\x01\x02" + SECRET.encode() + b"\x00\xff"), b64("Größe, " .encode("latin-1") + SECRET.encode()),
    b64(SECRET.encode("utf-16")), b64(SECRET.encode("utf-16-be")), b64(gzip.compress(b"\xff\x00" + SECRET.encode())),
    "k_" + b64(b"??>?>" + SECRET.encode()), "ab/" + b64(zlib.compress(SECRET.encode())), "abc-" + b64(SECRET),
    quote("é" + SECRET, safe="", encoding="latin-1"), "".join(f"\\x{b:02x}" for b in b"\xe9" + SECRET.encode())])
def test_secrets_in_wrapped_joined_and_binary_layers(wrapped):
    text = f"Größe {wrapped} end"
    spans, oversize = secrets.all_spans(text)
    assert "assign" in {s[0] for s in spans} and not oversize
    assert all(6 <= a < b <= 6 + len(wrapped) for _, a, b in spans)
    assert secrets.all_spans(secrets.masked(text))[0] == [] and secrets.masked(text).endswith(" end")


def test_lines_of_tokens_keep_their_own_spans():
    tokens = [b64("nothing in here at all ok"), b64(SECRET + " ab"), b64("nothing in there at all")]
    text = "\n".join(t.rstrip("=") for t in tokens)
    a = text.index(tokens[1].rstrip("="))
    assert secrets.all_spans(text)[0] == [("assign", a, a + len(tokens[1].rstrip("=")))]


@pytest.mark.parametrize("token", [
    b64(SECRET.encode("utf-16")), b64("Größe, ".encode("latin-1") + SECRET.encode()), b64(SECRET),
    base64.encodebytes((LONG[:45] + SECRET + " " + LONG * 3).encode()).decode().strip()])
@pytest.mark.parametrize("between", [" and ", ". Then, once more: "])
def test_equal_layers_at_several_places_are_all_found(token, between):
    text = f"a {token}{between}{token} end"
    second = 2 + len(token) + len(between)
    spans = secrets.all_spans(text)[0]
    first_ones = {(k, a - 2, b - 2) for k, a, b in spans if b <= 2 + len(token)}
    assert first_ones and first_ones == {(k, a - second, b - second) for k, a, b in spans if a >= second}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["utf-16", "utf-16-be", "latin-1", "utf-8"]), min_size=1, max_size=4), st.integers(1, 30))
def test_layers_repeated_at_random_places(encodings, gap):
    tokens = [b64(("é, " + SECRET).encode(e)) for e in encodings] * 2
    text, places = "", []
    for t in tokens:
        text += "- " * gap
        places.append((len(text), len(text) + len(t)))
        text += t + " "
    spans = secrets.all_spans(text)[0]
    assert all(any(a <= x and y <= b for _, x, y in spans) for a, b in places)


@pytest.mark.parametrize("text", ["password&equals;hunter2hunter2", "password&colon; hunter2hunter2", "&quot;password&quot;&colon;hunter2hunter2"])
def test_named_references(text):
    spans = secrets.all_spans(text + " AT&T &nosuch; &amp")[0]
    assert ("assign", text.index("password"), len(text)) in spans
