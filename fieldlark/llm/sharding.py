"""Placement of keys on shards by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own; the
shards take turns, each claiming the next slot of its order that is still free.
All shards so end up with the same number of slots (give or take one), and when
a shard goes, nearly all keys of the others stay where they are. The table is
broadcast: its size is a parameter, whatever the data.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SHARDS = 64
SLOTS = 8191  # prime, over 100 slots a shard


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard of each slot. *slots* must be prime and at least the number of shards."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have names of their own, and there must be a slot for each")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    at = [int(d[:15], 16) % slots for d in digests]
    step = [int(d[15:30], 16) % (slots - 1) + 1 for d in digests]
    table, claimed = [-1] * slots, 0
    while claimed < slots:
        for i in range(min(len(shards), slots - claimed)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
        claimed += min(len(shards), slots - claimed)
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: Sequence[str] | None = None, slots: int = SLOTS,
          slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """*df* with the slot and the shard (index) of *key*; columns of these names are replaced.

    Rows of equal keys go to the same shard; a null key goes where the empty text
    goes. An empty table gives an empty result. No row is shuffled.
    """
    names = list(shards) if shards is not None else [f"shard-{i}" for i in range(SHARDS)]
    claimed = F.from_json(F.lit(json.dumps(lookup_table(names, slots))), "array<int>")
    # slots rows of two numbers: bounded by the parameter
    table = df.sparkSession.range(0, slots, 1, 1).select(
        F.col("id").alias("__slot"), F.element_at(claimed, (F.col("id") + 1).cast("int")).alias("__shard"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_column, shard_column)]
    return (
        df.withColumn("__slot", slot_of(F.col(f"`{key}`"), slots))
        .join(F.broadcast(table), "__slot")
        .select(*kept, F.col("__slot").alias(slot_column), F.col("__shard").alias(shard_column))
    )
