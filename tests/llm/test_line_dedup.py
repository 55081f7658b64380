from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from fieldlark.llm.line_dedup import drop_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(BLANKS).translate(LOWER)].add(doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = line.strip(BLANKS).translate(LOWER)
            docs = holders[key] - {None}
            gone = len(key) >= min_chars and len(docs) >= min_docs and (doc is None or doc < max(docs))
            kept += [] if gone else [line]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def result(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_lines(df, **how).select("doc_id", "kept_text", "n_lines", "n_dropped")
    return Counter(tuple(r) for r in got.collect())


LONG = "This line is long enough to be dropped"


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (None, None)],
    [(1, LONG), (2, LONG), (3, LONG)],
    [(1, LONG), (1, LONG), (2, LONG)],  # two documents, three rows
    [(1, f"{LONG}\n{LONG}\n{LONG}"), (2, "x")],  # one document, three lines
    [(1, f"\x0b {LONG.upper()}\t\r\nx\n"), (2, f"a\n{LONG}"), (3, f"{LONG}\n\n{LONG}"), (3, "other"), (None, f"b\n{LONG}")],
    [(None, LONG), (None, LONG), (1, LONG), (2, LONG)],  # rows without an id are no documents
    [(i, "a" * 19 + "\n" + "é" * 20 + "\n" + "É" * 20) for i in range(4)],
    [(i, f" {LONG}") for i in range(3)] + [(9, LONG)],  # only ASCII white space is stripped
    [(7, LONG)] * 50 + [(8, f"{LONG}\nend")] * 3 + [(9, LONG)] * 20,
])
def test_cases(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_random_texts_and_thresholds(spark):
    draw = random.Random(5)
    pool = ["short", LONG, LONG.lower(), f"  {LONG}\t", "Ärger mit einer langen Zeile", "ärger mit einer langen Zeile", "", " " * 30,
            *[f"line number {i} of the common pool" for i in range(12)]]
    rows = [(draw.choice([None, *range(25)]), "\n".join(draw.choice(pool) for _ in range(draw.randrange(9)))) for _ in range(80)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, min_chars=3, min_docs=6) == brute(rows, 3, 6)


def test_very_long_text(spark):
    many = "\n".join([f"{LONG} {i % 3}" for i in range(20_000)])
    rows = [(i, many) for i in (1, 2, 3)] + [(4, "y" * 300_000)]
    assert result(spark, rows) == brute(rows)


def test_other_columns_stay_and_names_may_clash(spark):
    df = spark.createDataFrame([(i, LONG, "a", 5, i) for i in range(3)], "doc_id long, text string, n_lines string, pos int, `a.b` long")
    got = drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "a.b", "kept_text", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, LONG, 5, 0, "", 1, 1), (1, LONG, 5, 1, "", 1, 1), (2, LONG, 5, 2, LONG, 1, 0)]
