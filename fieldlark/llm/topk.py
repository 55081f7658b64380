"""Exact top-k by inner product: tiles of queries times tiles of candidates.

The query vectors go out in blocks of bounded size, one pass over the candidates
per block. A task multiplies tiles of both, keeps the best k of every tile and
folds them into one running list per query; the lists of the tasks are merged in
two levels, so no task ever sees more than a part of the lists of a query first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

QUERY_TILE, ROW_TILE = 512, 4096
BLOCK_VALUES = 1 << 22  # numbers in one broadcast block of queries: 32 MB
FANOUT = 32  # lists of a query are merged in this many groups, then once more


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: float = 256.0) -> DataFrame:
    """(id, vec): each component x as floor(scale * x). Null ids and vectors that are null, or hold null or
    non-finite components, are left out."""
    x = F.col(f"`{vector_column}`").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & sound).select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("long")).alias("vec"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; exact, in floating point only where that is exact."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -(2**63) + 2, 2**63 - 2).astype(np.int64)


def best_of_tile(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores with their ids, ties to the smaller id. *ids* are ascending."""
    n = score.shape[1]
    if n <= k:
        order = np.argsort(-score, axis=1, kind="stable")
    elif np.abs(score).max(initial=0) < 2**62 // n:
        key = score * n + np.arange(n - 1, -1, -1)
        part = np.argpartition(key, n - k, axis=1)[:, n - k:]
        order = np.take_along_axis(part, np.argsort(-np.take_along_axis(key, part, 1), axis=1), 1)
    else:
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(score, order, 1), ids[order]


class Lists:
    """Running top lists of a block of queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.valid = np.zeros((len(ids), 0), bool)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        k = min(self.k, len(ids))
        score, found, valid = ([], [], [])
        for a in range(0, len(self.ids), QUERY_TILE):
            own = self.ids[a: a + QUERY_TILE]
            s = products(self.vectors[a: a + QUERY_TILE], rows)
            left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            mine = np.zeros(s.shape, bool)
            for i in np.flatnonzero(right > left):
                mine[i, left[i]: right[i]] = True
            # rows of the query's own id sink to the bottom and are marked
            if mine.any():
                s = np.where(mine, int(s.min()) - 1, s)
            top, at = best_of_tile(s, ids, k)
            score.append(top)
            found.append(at)
            valid.append(at != own[:, None])
        score = np.concatenate([self.score, np.concatenate(score)], 1)
        found = np.concatenate([self.found, np.concatenate(found)], 1)
        valid = np.concatenate([self.valid, np.concatenate(valid)], 1)
        order = np.lexsort((found, -score, ~valid), axis=1)[:, : self.k]
        self.score, self.found, self.valid = (np.take_along_axis(x, order, 1) for x in (score, found, valid))


def by_length(ids: pa.Array, vec: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors as the rows of one matrix per length, with their ids."""
    ids, lengths = ids.to_numpy(zero_copy_only=False), vec.value_lengths().to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(lengths), vec.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield d, ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)]


def tile_lists(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """Best k of this task's rows for every query of the block."""
    lists = {d: Lists(ids, vectors, k) for d, (_, ids, vectors) in block.value.items()}
    for batch in batches:
        for a in range(0, batch.num_rows, ROW_TILE):
            part = batch.slice(a, ROW_TILE)
            for d, ids, rows in by_length(part.column("id"), part.column("vec")):
                if d in lists:
                    lists[d].add(ids, rows)
    part = TaskContext.get().partitionId()
    for d, (keys, ids, _) in block.value.items():
        row, col = np.nonzero(lists[d].valid)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys[row]), pa.array(ids[row]), pa.array(lists[d].found[row, col]),
            pa.array(lists[d].score[row, col]), pa.array(np.full(len(row), part, np.int64))],
            names=["key", "query_id", "vec_id", "score", "part"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Each query's *k* highest inner products among all candidates but those of its own id, ties to smaller ids.

    Both are (id, vec) of ``quantised``. Result: query_id, rank (from 1), vec_id, score. Vectors are compared with
    vectors of their own length only. A query row that is there twice is answered once; of candidates that share an
    id each row counts. No queries, or no candidates, give no rows; scores beyond 64 bits are held at the limit.
    """
    spark = candidates.sparkSession
    queries = queries.dropDuplicates(["id", "vec"])
    values = queries.agg(F.sum(F.size("vec") + 2).alias("n")).first().n or 0
    n_blocks = max(1, math.ceil(values / block_values))
    found = None
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("id", "vec"), F.lit(n_blocks)) == b).toArrow()  # one bounded block
        block, at = {}, 0
        for d, ids, vectors in by_length(own["id"].combine_chunks(), own["vec"].combine_chunks()):
            order = np.lexsort((*vectors.T[::-1], ids))
            block[int(d)] = ((b << 40) + at + np.arange(len(ids), dtype=np.int64), ids[order], vectors[order])
            at += len(ids)
        sent = spark.sparkContext.broadcast(block)
        part = candidates.mapInArrow(
            lambda batches, sent=sent: tile_lists(batches, sent, k),
            "key long, query_id long, vec_id long, score long, part long")
        found = part if found is None else found.unionByName(part)
    best = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("key", "group").orderBy(*best)
    every = Window.partitionBy("key").orderBy(*best)
    return (
        found.withColumn("group", F.pmod("part", F.lit(FANOUT)))
        .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
