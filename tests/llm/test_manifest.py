from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from fieldlark.llm.manifest import build_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def climb(nodes):
    """The root, and per node its path: (before, behind) on each level."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                step = "".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)
                for k in spans[i]:
                    paths[k].append(step)
        nodes, spans = [H(*[nodes[j] for j in run]) for run in runs], [sum((spans[j] for j in run), []) for run in runs]
    return nodes[0], paths


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *climb([leaf(r) for r in own])
    root, upper = climb([trees[s][1] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, upper):
        own, subroot, paths = trees[s]
        for row, path in zip(own, paths):
            path = path + above
            doc, *rest, text = row
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                text = text.translate(LOWER)
            end = leaf((doc, *rest, text))
            for before, behind in path:
                end = H(before, end, behind)
            out.append((doc, leaf(row), subroot, root, H(*[x for step in path for x in step]), end, end == root))
    return Counter(out)


def rows_of(n, source, text="Some Text"):
    return [(i, source, "en", len(text), f"{text} {i}") for i in range(n)]


def result(spark, rows):
    got = build_manifest(spark.createDataFrame(rows, SCHEMA)).drop("siblings")
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None)],
    [(None, None, None, None, None), (None, "", "", 0, ""), (5, "a", None, -3, "Ä B")],
    rows_of(16, "a") + rows_of(17, None) + rows_of(1, "b"),
    rows_of(258, "a") + [(i, f"s{i}", None, None, "X") for i in range(20)],
    [(3, "a", "en", 1, "Same Text")] * 40 + [(3, "a", "en", 1, "other")] * 3 + [(None, "a", "en", 1, "T")] * 2,
    [(1, "Z", "x", 1, "t"), (1, "a", "x", 1, "t"), (1, "é", "x", 1, "t"), (1, "\U0001f600", "x", 1, "t"), (1, "￮", "x", 1, "t")],
    [(10, "a", "en", 1, "WORD " * 50_000), (11, "a", "en", 1, "x")],
], ids=["empty", "one", "nulls", "runs", "levels", "repeated", "order", "long"])
def test_against_brute_force(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_tampering_is_found_where_it_changes_the_text(spark):
    got = build_manifest(spark.createDataFrame(rows_of(60, "a"), SCHEMA)).select("doc_id", "verified").collect()
    assert {r[0] for r in got if not r[1]} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_other_columns_are_left_aside(spark):
    df = spark.createDataFrame([(1, "a", "en", 1, "t", "x", 9)], SCHEMA + ", leaf string, __pos long")
    assert [tuple(r) for r in build_manifest(df).drop("siblings").collect()] == list(brute([(1, "a", "en", 1, "t")]))


def test_no_window_holds_more_than_a_run(spark):
    plan = build_manifest(spark.createDataFrame(rows_of(40, "a"), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]
    assert windows and all("[__group" in w and "__run" in w.split("], [")[1] for w in windows)
