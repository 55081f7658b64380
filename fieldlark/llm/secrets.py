"""Secrets in texts, also in text that is wrapped in encodings.

A worklist of layers starts with the text itself. Each layer is scanned; then what
it wraps (percent-encoding, Unicode escapes, base64, and compressed data inside
those) becomes new layers, until nothing new turns up. A layer that occurs among
the layers it came from is a cycle and is not followed. Every layer knows where
its characters come from, so a find in any depth has a span in the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
MASK = "[REMOVED]"
MAX_LAYER = 32 << 20  # bytes of unwrapped text held at once: a longer text is read piece by piece; one token that is
# longer than this is read in parts that overlap, reported as oversize with its span, and masked

# fixed values: the patterns asked for
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more are the runs of any length, less the short ones
_KEYWORDS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
    r"|&[A-Za-z][A-Za-z0-9]{1,31};")
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})(?:={1,2}|(?:%3[Dd]){1,2})?")
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+)((?:={1,2}|(?:%3[Dd]){1,2})?)")
# what a layer must hold to be of use: a part of a secret, or of something that can be unwrapped
_WORTH = re.compile(rb"passw|secret|token|api|AKIA|[0-9a-f]{24}|%[0-9a-f]{2}|\\[ux]|&[#a-z]|[a-z0-9+/_-]{16}", re.I)
_UNCLEAN = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
_PLAIN = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f]*")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of a text as it stands, leftmost and not overlapping within a kind, in the order asked for."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


@dataclass
class Layer:
    """A text with the place in the original of each character: two arrays, or one span for all of them."""
    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    span: tuple[int, int] | None
    ancestors: frozenset[bytes]
    done: tuple[tuple[int, int], ...] = ()  # places in the original whose inside other layers cover

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.span is not None:
            return self.span
        if self.starts is None:
            return a, b
        return int(self.starts[a]), int(self.ends[b - 1])


class Broken(Exception):
    """Compressed data that cannot be read to its end."""


def magic(data: bytes):
    """A reader for the compressed data that starts with *data*; None if it is not compressed."""
    if data[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0 and data[0] >> 4 <= 7:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def inflated(first: bytes, source: Iterator[bytes], step: int) -> Iterator[bytes]:
    """Content, in parts of at most *step* bytes, of compressed data that comes in parts; all members of joined
    streams, and what stands behind the last one as it is. Data that breaks off gives what was read before."""
    reader, data = magic(first), first
    while reader is not None:
        try:
            if isinstance(reader, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                out = reader.decompress(data, step)
                data = b""
                hungry = not reader.eof and reader.needs_input
            else:
                out = reader.decompress(data, step)
                data = reader.unconsumed_tail
                hungry = not reader.eof and not data and len(out) < step
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError) as error:
            raise Broken from error
        if out:
            yield out
        if reader.eof:
            data = reader.unused_data.lstrip(b"\0") if isinstance(reader, lzma.LZMADecompressor) else reader.unused_data
            while len(data) < 6 and (more := next(source, None)) is not None:
                data += more
            reader = magic(data)
        elif hungry:
            data = next(source, None)
            if data is None:
                return
    if data:
        yield data
    yield from source


def content(data: bytes, raw: bool = True) -> Iterator[bytes | None]:
    """The content of nested gzip, zlib, bzip2 and xz data in parts of bounded size; data of no such kind as it is.
    A None among the parts stands for something that could not be read; an empty part ends what belongs together.
    Without *raw*, data that only look compressed give nothing themselves."""
    step, seen = max(MAX_LAYER // 8, 16), set()
    source, first, deep = iter(()), data, False
    while magic(first) is not None:
        digest = hashlib.sha1(first).digest()
        if digest in seen:  # data that holds itself
            if len(first) >= step:
                yield None
            return
        seen.add(digest)
        inner = inflated(first, source, step)
        try:
            held = b""
            while len(held) < step and (part := next(inner, None)) is not None:
                held += part
        except Broken:  # what was read, and the data as it is
            if held:
                yield held
                yield b""
            if deep or raw:
                yield first
            if deep and len(first) >= step:
                yield None
            return
        if not held:
            return
        first, source, deep = held, inner, True
    yield first
    try:
        yield from source
    except Broken:
        yield None


# a place where nothing that is looked for goes on: behind a line whose end is no part of a token
_SAFE = re.compile(rb"(?:[.,\"'()\[\]>|!?#*]|[^0-9A-Fa-f]\}|\n|[ \t][^\s]{0,15})[ \t]*\r?\n")


def pieces(data: bytes, raw: bool = True) -> Iterator[bytes | None]:
    """What *data* holds, cut where no token goes on, so that the pieces can be looked at one by one. A None stands for
    something that could not be read as a whole: it is longer than MAX_LAYER without such a place."""
    step, held, first = max(MAX_LAYER // 8, 16), b"", True
    for part in content(data, raw):
        if not part:
            if held:
                yield held
            if part is None:
                yield None
            held, first = b"", True
            continue
        if not first:
            part = part.replace(b"\0", b"")  # a long UTF-16 text has no other place to cut
        held, first = held + part, False
        if len(held) < 2 * step:
            continue
        held = held.replace(b"\0", b"")
        cut = 0
        for m in _SAFE.finditer(held, max(len(held) - step, 0)):
            cut = m.end()
        if cut:
            yield held[:cut]
            held = held[cut:]
        elif len(held) > MAX_LAYER:
            yield held
            yield None
            held = held[-(step // 8):]
    if held:
        yield held


def plain_text(data: bytes) -> str | None:
    """*data* as text; None if it is none."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and _PLAIN.fullmatch(text) else None


def texts_of(data: bytes, raw: bool = True) -> Iterator[str | None]:
    """Texts that *data* holds, decompressed, one character a byte where it is no UTF-8 text; a None for each part
    that cannot be read."""
    for piece in pieces(data, raw):
        if piece is None:
            yield None
        elif (text := plain_text(piece)) is not None:
            yield text
        elif _WORTH.search(piece.replace(b"\0", b"")):
            yield piece.decode("latin-1")


def rewritten(layer: Layer, pattern: re.Pattern, decode) -> tuple[Layer | None, list[tuple[bytes, int, int]]]:
    """The layer with every match of *pattern* replaced by what *decode* gives, if that is a text; and
    data that stand on their own (compressed), with their span in the layer."""
    pieces, starts, ends, apart, at = [], [], [], [], 0
    own = np.arange(len(layer.text) + 1)
    own_starts, own_ends = (own[:-1], own[1:]) if layer.starts is None else (layer.starts, layer.ends)
    for m in pattern.finditer(layer.text):
        parts = decode(m[0])
        if parts is None:
            continue
        text, unit = parts
        if unit is None:
            apart.append((text, *m.span()))
            continue
        pieces += [layer.text[at: m.start()], text]
        starts += [own_starts[at: m.start()], own_starts[m.start() + np.array(unit[0], int)]]
        ends += [own_ends[at: m.start()], own_ends[m.start() + np.array(unit[1], int) - 1]]
        at = m.end()
    if not pieces:
        return None, apart
    text = "".join(pieces) + layer.text[at:]
    starts, ends = np.concatenate([*starts, own_starts[at:]]), np.concatenate([*ends, own_ends[at:]])
    if layer.span is not None:
        starts = ends = None
    return Layer(text, starts, ends, layer.span, layer.ancestors, layer.done), apart


def _units(text: str, sizes: list[int]) -> tuple[list[int], list[int]]:
    """Start and end, in the encoded run, of each character that took *sizes* encoded characters."""
    ends = list(np.cumsum(sizes))
    return [e - s for e, s in zip(ends, sizes)], ends


def decode_percent(run: str):
    data = bytes.fromhex(run.replace("%", ""))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return (data.decode("latin-1"), _units(run, [3] * len(data))) if magic(data) is None else (data, None)
    return text, _units(text, [3 * len(c.encode()) for c in text])


def decode_escapes(run: str):
    try:
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16)), ([0], [len(run)])
        if run.startswith("\\U"):
            return chr(int(run[2:], 16)), ([0], [len(run)])
        if run.startswith("&#"):
            code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
            return None if 0xD800 <= code < 0xE000 else (chr(code), ([0], [len(run)]))
        if run.startswith("&"):
            text = html.unescape(run)
            return None if text == run else (text, ([0] * len(text), [len(run)] * len(text)))
        if run.startswith("\\u"):
            units = [int(x, 16) for x in run.split("\\u")[1:]]
            text = b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "surrogatepass")
            return text, _units(text, [12 if ord(c) > 0xFFFF else 6 for c in text])
        data = bytes.fromhex(run.replace("\\x", ""))
        try:
            text = data.decode("utf-8")
            return text, _units(text, [4 * len(c.encode()) for c in text])
        except UnicodeDecodeError:
            return (data.decode("latin-1"), _units(run, [4] * len(data))) if magic(data) is None else (data, None)
    except (ValueError, OverflowError):
        return None


def base64_bytes(part: str) -> bytes:
    """The bytes of base64 characters; of one too many, those before it."""
    part = part[: len(part) - (len(part) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(part + "=" * (-len(part) % 4))


def base64_tokens(text: str) -> Iterator[list[tuple[int, int, int]]]:
    """Base64 tokens of a text, as (start, end of the characters, end of the padding) of each line they are wrapped
    into: all lines but the first and the last are equally long, the last one is no longer."""
    at = 0
    while m := _BASE64.search(text, at):
        lines, width = [(m.start(1), m.end(1), m.end())], 0
        while lines[-1][1] == lines[-1][2] and (n := _NEXT_LINE.match(text, lines[-1][2])):
            if width and len(n[1]) > width:
                break
            lines.append((n.start(1), n.end(1), n.end()))
            if width and len(n[1]) < width:
                break
            width = len(n[1])
        yield lines
        at = lines[-1][2]


def strict_parts(token: str, end: int) -> Iterator[tuple[str | None, int, int, bool]]:
    """Texts, with their place, that a token of one line (padding from *end* on), or the parts of it between
    separators, decodes to; last whether it is a clean text as a whole. A None for what cannot be read."""
    body = token[:end]
    for m in re.finditer(r"\A.*\Z|[A-Za-z0-9+]{16,}", body, re.S):
        if len(m[0]) % 4 == 1:
            continue
        data, place = base64_bytes(m[0]), (m.start(), len(token) if m.end() == end else m.end())
        if (text := plain_text(data)) is not None:
            yield text, *place, True
        elif magic(data) is not None:
            yield from ((text, *place, False) for text in texts_of(data, raw=False))


def decode_base64(text: str, lines: list[tuple[int, int, int]]):
    """What a token in a text holds, as (text, start, end, None) if it has the span of the token or of a part of it,
    and (text, starts, ends, done) with the place of each character and the places that the former have covered.

    Lines and parts between separators that are clean texts come first. Then all lines are read as one, from each of
    the four phases, bytes as they are: so whatever stands behind a prefix of any length is read too, also when it is
    binary, Latin-1 or UTF-16; compressed data, and a clean rest, may begin behind each separator or line end.
    """
    done = []
    for a, b, end in lines:
        body = text[a:b]
        whole = False
        for found, x, y, clean in strict_parts(text[a:end], b - a):
            if whole:
                break
            yield found, a + x, a + y, None
            if clean:
                done.append((a + x, a + y))
                whole = (x, y) == (0, end - a)
    if len(lines) == 1 and whole:
        return
    body = "".join(text[a:b] for a, b, _ in lines)
    at = np.concatenate([np.arange(a, b) for a, b, _ in lines])
    heads = sorted({0, *np.cumsum([b - a for a, b, _ in lines[:-1]]).tolist(), *(m.end() for m in re.finditer("[/_-]", body))})
    phases = [base64_bytes(body[p:]) for p in range(4)]
    last = [max((m.start() for m in _UNCLEAN.finditer(data)), default=-1) for data in phases]
    clean = [False] * 4
    for head in heads:
        p, byte = head % 4, head // 4 * 3
        data = phases[p]
        if magic(data[byte: byte + 6]) is not None and (head or len(lines) > 1):
            for found in texts_of(data[byte:], raw=False):
                yield found, int(at[head]), lines[-1][2], None
        elif len(lines) == 1 and not clean[p] and byte > last[p] and len(body) - head >= 16:
            clean[p] = True
            if head and (found := plain_text(data[byte:])) is not None:
                yield found, int(at[head]), lines[-1][2], None
                done.append((int(at[head]), lines[-1][2]))
    for p, data in enumerate(phases):
        if _WORTH.search(data.replace(b"\0", b"")):
            k = np.arange(len(data))
            ends = at[np.minimum(p + (4 * k + 7) // 3 - 1, len(at) - 1)] + 1
            yield data.decode("latin-1"), at[p + 4 * k // 3], ends, tuple(done)


def unwrapped(layer: Layer, oversize: list[tuple[int, int]]) -> Iterator[Layer]:
    """The layers directly inside a layer, one at a time."""
    def apart(texts):
        for text, a, b in texts:
            if text is None:
                oversize.append(layer.place(a, b))
            else:
                yield Layer(text, None, None, layer.place(a, b), layer.ancestors)

    for pattern, decode, sign in ((_PERCENT, decode_percent, "%"), (_ESCAPES, decode_escapes, None)):
        if sign and sign not in layer.text or not sign and "\\" not in layer.text and "&" not in layer.text:
            continue
        inner, parts = rewritten(layer, pattern, decode)
        if inner is not None:
            yield inner
        for data, a, b in parts:
            yield from apart((text, a, b) for text in texts_of(data))
    if "\0" in layer.text and layer.ancestors:  # UTF-16 and UTF-32, in any order and place
        own = np.flatnonzero(np.array([c != "\0" for c in layer.text]))
        placed = layer.span is None and layer.starts is not None
        yield Layer(layer.text.replace("\0", ""), layer.starts[own] if placed else None, layer.ends[own] if placed else None,
                    layer.span, layer.ancestors, layer.done)
    for lines in base64_tokens(layer.text):
        for text, a, b, done in decode_base64(layer.text, lines):
            if done is None:
                yield from apart([(text, a, b)])
            elif layer.span is not None:
                yield Layer(text, None, None, layer.span, layer.ancestors)
            else:
                starts, ends = (a, b) if layer.starts is None else (layer.starts[a], layer.ends[b - 1])
                yield Layer(text, starts, ends, None, layer.ancestors,
                            layer.done + tuple(layer.place(x, y) for x, y in done))


def all_spans(text: str, base: list[Span] | None = None) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans in the original text of secrets in any layer, the base ones among them, and spans of oversize layers."""
    found = set(base_spans(text) if base is None else base)
    oversize: list[tuple[int, int]] = []
    digest = lambda s: hashlib.sha1(s.encode("utf-8", "surrogatepass")).digest()
    root, seen = Layer(text, None, None, None, frozenset()), set()
    work = [(root, unwrapped(root, oversize))]  # the layers that are open, each inside the one before
    while work:
        layer, rest = work[-1]
        inner = next(rest, None)
        if inner is None:
            work.pop()
            continue
        own, inside = digest(inner.text), layer.ancestors or frozenset((digest(text),))
        where = inner.place(0, len(inner.text)) if inner.text else inner.span
        if own in inside or (where, own) in seen:
            continue
        seen.add((where, own))
        inner.ancestors = inside | {own}
        for kind, a, b in base_spans(inner.text):
            a, b = inner.place(a, b)
            if not any(x <= a and b <= y for x, y in inner.done):
                found.add((kind, a, b))
        work.append((inner, unwrapped(inner, oversize)))
    return in_order(found), sorted(set(oversize))


def masked(text: str, mask: str = MASK) -> str:
    """*text* with every span of a secret, and of what could not be read, replaced, until none is left."""
    while True:
        spans, oversize = all_spans(text)
        places = sorted([s[1:] for s in spans] + oversize)
        if not places:
            return text
        pieces, at = [], 0
        for a, b in places:
            if a >= at:
                pieces += [text[at:a], mask]
            at = max(at, b)
        text = "".join(pieces) + text[at:]


ADDED = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string",
         "oversize": "string"}


def find(df: DataFrame, text_column: str = "text") -> DataFrame:
    """*df* with the base counts and digest, all spans (kind:start:end in code points, end exclusive, in order of start,
    kind and end, comma-joined), and spans of oversize layers likewise. Columns of these names are replaced.

    A null text counts as empty and has no spans. Each row counts by itself, repeated ones too; whole texts are read;
    an empty table stays empty.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                base = base_spans(text or "")
                spans, oversize = all_spans(text or "", base)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(),
                             written(spans), ",".join(f"{a}:{b}" for a, b in oversize)))
            columns = list(zip(*rows)) or [()] * 6
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"]
            new = [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(columns, ADDED.values())]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(c for c in batch.schema.names if c != "__text"), *ADDED])

    kept = [c for c in df.columns if c not in ADDED]
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_column}`").alias("__text"))
    schema = source.drop("__text").schema
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def remove(df: DataFrame, text_column: str = "text", mask: str = MASK) -> DataFrame:
    """*df* with secrets in *text_column* masked; no row goes, null texts stay null."""
    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, mask) for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_column else batch.column(i)
                 for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
