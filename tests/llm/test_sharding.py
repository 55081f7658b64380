from collections import Counter

import pytest

from fieldlark.llm import sharding
from fieldlark.session import small_table

NAMES = [f"shard-{i}" for i in range(64)]


def test_slots_are_shared_evenly():
    counts = Counter(sharding.lookup_table(NAMES))
    assert sorted(counts) == list(range(64)) and max(counts.values()) - min(counts.values()) <= 1


def test_most_slots_stay_when_a_shard_goes():
    before = sharding.lookup_table(NAMES)
    left = NAMES[:10] + NAMES[11:]
    after = sharding.lookup_table(left)
    moved = sum(NAMES[a] != left[b] for a, b in zip(before, after) if a != 10)
    assert moved < 0.1 * len(before)


@pytest.mark.parametrize("names, slots", [(["a", "a"], 7), ([], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_parameters(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_rows_and_columns(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "n", "y"), (2, None, "z")]
    df = small_table(spark, rows, "doc_id long, slot string, text string")
    out = sharding.place(df, "doc_id", ["p", "q"], 7)
    assert out.columns == ["doc_id", "text", "slot", "shard"]
    got = out.collect()
    assert len(got) == 4 and len({(r.slot, r.shard) for r in got if r.doc_id == 1}) == 1
    table = sharding.lookup_table(["p", "q"], 7)
    assert all(table[r.slot] == r.shard for r in got)
    empty = small_table(spark, [("",)], "doc_id string")
    assert sharding.place(empty, "doc_id", ["p", "q"], 7).first().slot == [r.slot for r in got if r.doc_id is None][0]
    assert sharding.place(df.limit(0), "doc_id").collect() == []


def test_only_the_table_is_broadcast_and_nothing_is_shuffled(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.place(df.select("doc_id"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan and "Python" not in plan
