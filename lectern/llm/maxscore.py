"""Exact top-k by inner product with MaxScore over dimension postings.

A query's terms are its dimensions. In a shard of candidates each dimension has a posting column
with its smallest and largest value, which bound what it can add to a query's score. Dimensions
are taken by falling bound; the last ones, whose bounds together stay below a quarter of the
query's threshold, its k-th best score so far, are non-essential, the others essential. The
product of the lengths of query and candidate bounds them too. Essential postings are
traversed for all candidates (one matrix product for many queries); the others are probed one at a
time, and only for candidates that can still compete. Shards run in parallel and keep k rows a
query, which are merged at the end. Queries come in blocks of bounded size, each sent to every
shard; candidates are never copied or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

QUERY_BLOCK = 8192
SHARD_ROWS = 2048
QUERY_ROWS = 256
SPLIT = 4
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of every component; rows without id, vector or with a null or non-finite component are left out."""
    x = F.transform(vectors[vector_col], lambda e: e.cast("double"))
    rows = vectors.select(vectors[id_col].alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    fine = F.forall("x", lambda e: F.coalesce((F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False)))
    return rows.where(fine).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a float matrix of ``width`` columns, shorter rows filled with zero."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(width, int(sizes.max(initial=0)))), np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Best:
    """The k best (score, id) of each query, and its threshold."""

    def __init__(self, queries: int, k: int):
        self.k, self.q = k, queries
        self.owner = np.zeros(0, np.int64)
        self.score, self.ids = np.zeros(0), np.zeros(0, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, owner, score, ids):
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < self.k
        self.owner, self.score, self.ids = owner[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.floor[self.owner[last]] = self.score[last]


def _scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, best: _Best, at: int) -> None:
    """MaxScore of the candidates ``x`` for the queries ``q``, which are number ``at`` and following in ``best``."""
    floor = best.floor[at:at + len(q)]
    low, high = x.min(0), x.max(0)
    top = np.maximum(q * low, q * high)
    order = np.argsort(-top, axis=1, kind="stable")
    tops = np.take_along_axis(top, order, 1)
    # The most that this dimension and all later ones add: the sum of their bounds, or the product of lengths.
    lengths = np.sqrt(np.cumsum(np.take_along_axis(q, order, 1)[:, ::-1] ** 2, 1)[:, ::-1])
    longest = np.sqrt((x * x).sum(1).max())
    after = np.minimum(np.cumsum(tops[:, ::-1], 1)[:, ::-1], np.ceil(lengths * longest * (1 + 1e-9)))
    # Non-essential: together they stay below a part of the threshold; a candidate gains the rest from the others.
    essential = (np.maximum(after, 0) >= floor[:, None] / SPLIT).sum(1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(q.shape[1]), order.shape), 1)
    after = np.c_[after, np.zeros(len(q))]
    partial = x @ np.where(rank < essential[:, None], q, 0.0).T
    own = np.isin(ids, qids)
    for i in np.flatnonzero(own):
        partial[i, qids == ids[i]] = -np.inf
    limit = floor - after[np.arange(len(q)), essential]
    if np.isneginf(floor).any() and len(x) > best.k:
        full = np.flatnonzero(essential == q.shape[1])
        kth = np.partition(partial[:, full], len(x) - best.k, axis=0)[len(x) - best.k]
        limit[full] = np.maximum(limit[full], kth)
    rows, owner = np.nonzero(partial >= limit)
    score = partial[rows, owner]
    seen = ~np.isneginf(score)
    rows, owner, score = rows[seen], owner[seen], score[seen]
    for step in range(int(essential.min(initial=0)), q.shape[1]):
        if not len(rows):
            return
        todo = essential[owner] <= step
        d = order[owner, step]
        score = score + np.where(todo, x[rows, d] * q[owner, d], 0.0)
        alive = score + np.where(todo, after[owner, step + 1], after[owner, essential[owner]]) >= floor[owner]
        rows, owner, score = rows[alive], owner[alive], score[alive]
    best.add(owner + at, score, ids[rows])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``k`` best of ``vectors``.

    Both have (vec_id, v) as ``integer_vectors`` gives them. Candidates with the query's own id are
    left out; ties go to the smaller vec_id; equal candidates each count; queries that are equal in
    id and vector each get their rows; vectors of unequal length are filled with zeros. Fewer than
    ``k`` candidates give fewer rows. Scores are exact up to 2**53.
    """
    spark = vectors.sparkSession
    asked = stored(queries.groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "topk-queries")
    count = asked.count()
    blocks = -(-count // QUERY_BLOCK)
    schema = "block int, q int, query_id long, copies long, vec_id long, score long"
    found = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block).orderBy("vec_id", "v").toArrow()
        sent = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), _matrix(mine.column("v").combine_chunks(), 0), mine.column("copies").to_numpy()))

        def task(batches, sent=sent, block=block):
            qids, q, copies = sent.value
            best = _Best(len(q), k)
            for batch in batches:
                for start in range(0, batch.num_rows, SHARD_ROWS):
                    part = batch.slice(start, SHARD_ROWS)
                    x, ids = _matrix(part.column(1), q.shape[1]), part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    asks = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
                    if np.abs(x).max(initial=0) * np.abs(asks).max(initial=0) * max(x.shape[1], 1) >= EXACT:
                        raise OverflowError("components too large for exact scores")
                    for at in range(0, len(asks), QUERY_ROWS):
                        _scan(x, ids, asks[at:at + QUERY_ROWS], qids[at:at + QUERY_ROWS], best, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(best.owner), block, np.int32)), pa.array(best.owner.astype(np.int32)), pa.array(qids[best.owner]),
                 pa.array(copies[best.owner]), pa.array(best.ids), pa.array(best.score.astype(np.int64))],
                names=["block", "q", "query_id", "copies", "vec_id", "score"])

        found.append(stored(vectors.mapInArrow(task, schema), "topk-part"))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = found[0]
    for more in found[1:]:
        merged = merged.union(more)
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
