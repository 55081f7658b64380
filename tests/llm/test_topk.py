import math
import random

import numpy as np
import pytest

from fieldlark.llm import topk
from fieldlark.session import small_table

SCHEMA = "vec_id long, embedding array<double>, rank int"


def brute(rows, k):
    sound = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({r for r in sound if r[0] % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in sound if c != q and len(w) == len(v))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def result(df, k, **options):
    vectors = topk.quantised(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 50 = 0"), k, **options).collect())


@pytest.mark.parametrize("block_values", [1 << 22, 20])
def test_same_as_brute_force(spark, block_values, monkeypatch):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(6)]) for i in range(330)]
    rows += [(i, [0.5] * 6) for i in range(400, 470)]  # ties
    rows += [(500, None), (550, [0.1, None, 1.0, 1.0, 1.0, 1.0]), (600, [math.nan] * 6), (650, [math.inf] * 6), (None, [1.0] * 6),
             (700, [1.0, 2.0]), (701, [1.0, 3.0]), (750, []), (751, []), (50, rows[50][1]), (401, [0.5] * 6), (100, [1.0] * 6)]
    df = small_table(spark, [(i, v, 1) for i, v in rows], SCHEMA).repartition(5)
    assert result(df, 5, block_values=block_values) == brute(rows, 5)
    assert result(df, 1000, block_values=block_values) == brute(rows, 1000)


def test_tiles(monkeypatch):
    draw = np.random.Generator(np.random.PCG64(4))
    for n, k in ((3, 5), (5, 5), (40, 5)):
        score, ids = draw.integers(-3, 3, (7, n)), np.arange(n) * 10
        top, at = topk.best_of_tile(score, ids, k)
        for i in range(7):
            want = sorted(zip(-score[i], ids))[:k]
            assert list(zip(-top[i], at[i])) == want


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**22, 2.0]), (3, [2.0**22, 4.0])]
    assert result(small_table(spark, [(i, v, 1) for i, v in rows], SCHEMA), 2) == brute(rows, 2)


def test_empty(spark):
    df = small_table(spark, [(1, [1.0], 1)], SCHEMA)
    assert result(df, 5) == [] and result(df.limit(0), 5) == []
    assert result(small_table(spark, [(0, [1.0], 1)], SCHEMA), 5) == []
