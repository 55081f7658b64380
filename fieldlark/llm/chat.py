"""Conversations as training text, checked by reading them back.

Grammar of a conversation: a sequence of turns, each

    <s>[KIND] body [/KIND]</s>                 KIND is SYS, INST or OUT
    <s>[ROLE=name][ROLE] body [/ROLE]</s>      any other role
    and the same with ~ behind KIND, or the second ROLE, where the body is escaped

A tokenizer splits a text at the control strings; the parser accepts exactly the
sequence above. A turn is first written as it is. Whatever does not come back
identical (because its text holds control strings) is written escaped and read
again, until the parsed turns equal the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
ROLES = {kind: role for role, kind in KINDS.items()}
LEARNED = "assistant"  # the loss mask covers this role's texts

_CONTROL = re.compile(r"</?s>|\[/?(?:SYS|INST|OUT|ROLE)~?\]|\[ROLE=")
_NAME = re.compile(r"([^\]]*)\]")
_CONTROL_START = re.compile(r"(?=</?s>|\[/?(?:SYS|INST|OUT|ROLE)~?\]|\[ROLE=)(.)")

Turn = tuple[str, str]


class NotInGrammar(ValueError):
    """A text that is no sequence of turns."""


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one behind the first character of every control string."""
    return _CONTROL_START.sub(r"\1" + "\\\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render_turn(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """A written turn with the place of its body."""
    kind, mark = KINDS.get(role), "~" if escaped else ""
    if kind is None:
        kind = "ROLE"
        name = "".join(c if c not in "]%\\<[" else f"%{ord(c):02X}" for c in role)
        head = f"<s>[ROLE={name}][ROLE{mark}] "
    else:
        head = f"<s>[{kind}{mark}] "
    body = escape(text) if escaped else text
    return f"{head}{body} [/{kind}]</s>", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str, bool, int, int]]:
    """Turns of a written conversation: role, body as written, whether it is escaped, its place."""
    turns, at, n = [], 0, len(text)
    tokens = _CONTROL.finditer(text)

    def take(expected: str | None = None) -> re.Match:
        token = next(tokens, None)
        if token is None or expected is not None and token[0] != expected:
            raise NotInGrammar(f"at {token.start() if token else n}")
        return token

    while at < n:
        start = take("<s>")
        head = take()
        if start.start() != at or head.start() != start.end():
            raise NotInGrammar(f"at {at}")
        role = None
        if head[0] == "[ROLE=":
            name = _NAME.match(text, head.end())
            mark = take()
            if not name or mark.start() != name.end() or mark[0] not in ("[ROLE]", "[ROLE~]"):
                raise NotInGrammar(f"at {head.start()}")
            role, head = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name[1]), mark
        kind = head[0].strip("[~]")
        if kind.startswith("/") or head[0] in ("<s>", "</s>") or (kind == "ROLE") != (role is not None):
            raise NotInGrammar(f"at {head.start()}")
        close = take(f"[/{kind}]")
        end = take("</s>")
        a, b = head.end() + 1, close.start() - 1
        if end.start() != close.end() or b < a or text[a - 1] != " " or text[b] != " ":
            raise NotInGrammar(f"at {close.start()}")
        turns.append((role if role is not None else ROLES[kind], text[a:b], head[0].endswith("~]"), a, b))
        at = end.end()
    return turns


def recovered(text: str) -> list[Turn]:
    return [(role, unescape(body) if escaped else body) for role, body, escaped, _, _ in parse(text)]


def comes_back(text: str, turn: Turn) -> bool:
    try:
        return recovered(text) == [turn]
    except NotInGrammar:
        return False


def render(turns: Iterable[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The written conversation and the places of the texts under the loss mask."""
    pieces, mask, at, source = [], [], 0, []
    for role, text in turns:
        piece, a, b = render_turn(role, text, False)
        if not comes_back(piece, (role, text)):
            piece, a, b = render_turn(role, text, True)
        pieces.append(piece)
        source.append((role, text))
        if role == LEARNED:
            mask.append((at + a, at + b))
        at += len(piece)
    whole = "".join(pieces)
    if recovered(whole) != source:
        raise AssertionError("a conversation does not come back from its text")
    return whole, mask


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Runs of equal ids of sorted rows, across batches."""
    own, turns, any_row = None, [], False
    for batch in batches:
        ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for i, role, text in zip(ids, roles, texts):
            if any_row and i != own:
                yield own, turns
                turns = []
            own, any_row = i, True
            turns.append((role or "", text or ""))
    if any_row:
        yield own, turns


def format_conversations(df: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows: conv_id, n_turns, formatted, loss_start, loss_end.

    Turns stand in the order of ``turn``, then role, then text; repeated rows are turns of their own. Null roles
    and texts count as empty, a null conv_id is an id like others, null turns come first. The loss places are
    code points of the formatted text, end exclusive, one pair per assistant turn. An empty table gives no rows.
    """
    def run(batches):
        for group in conversations(batches):
            text, mask = render(group[1])
            yield pa.RecordBatch.from_arrays([
                pa.array([group[0]], pa.int64()), pa.array([len(group[1])], pa.int64()), pa.array([text]),
                pa.array([[a for a, _ in mask]], pa.list_(pa.int64())),
                pa.array([[b for _, b in mask]], pa.list_(pa.int64()))],
                names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])

    return (
        df.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader gets from the formatted texts: turns, and the texts under the loss mask, unescaped."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                digest, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
                escaped_at = {(a, b): escaped for _, _, escaped, a, b in turns}
                for role, body, escaped, _, _ in turns:
                    digest.update(f"{role}\n{unescape(body) if escaped else body}\n".encode())
                for place in zip(r["loss_start"], r["loss_end"]):
                    under = r["formatted"][place[0]: place[1]]
                    under = unescape(under) if escaped_at[place] else under
                    loss.update(under.encode())
                    loss_chars += len(under)
                rows.append((r["conv_id"], len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(),
                             len(r["formatted"])))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")
