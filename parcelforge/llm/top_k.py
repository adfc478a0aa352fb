"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt to shards, queries to blocks, and each cell of the grid of
shards and blocks is one group of rows: no task holds more than a shard and a
block, and nothing comes to the driver but counts.

A shard has a sorted list of its vectors for each dimension. A query reads the
lists of its dimensions in step, from the top where its component is positive
and from the bottom where it is negative, scores each vector when it is first
seen, and stops when no unseen vector can beat its k-th result: the best that
is left at this depth, summed over the dimensions, is below it. Equal scores go
to the smaller id, so a bound that only equals the k-th score does not stop.
Where the lists show most of a shard at once, the scores are looked up in one
product for a few queries together; a vector still counts only when it is seen.
The last few unseen vectors of a shard are scored without reading further.

The results of a query's cells are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.tables import in_batches, materialize

#: Vectors of a shard and queries of a block, about.
SHARD_ROWS, QUERY_BLOCK = 8192, 8192
#: Queries whose scores are looked up in one product; a vector is one of the last when at most one in so many is unseen.
TOGETHER, LAST = 64, 16


def halves(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as (high, low), score = high * 2^62 + low with 0 <= low < 2^62, in order of the scores."""
    whole = [int(s) for s in scores.tolist()] if scores.dtype != np.int64 else scores
    mask = (1 << 62) - 1
    if isinstance(whole, np.ndarray):
        return whole >> 62, whole & mask
    most = (1 << 63) - 1
    return np.array([min(max(s >> 62, -most), most) for s in whole], np.int64), np.array([s & mask for s in whole], np.int64)


class Shard:
    """Vectors of one length with their sorted lists. Scores are exact at any size: in float32 where all sums stay below 2^24, in 64 bits where they fit, else as Python's integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order]
        self.biggest = max(int(self.whole.max(initial=0)), -int(self.whole.min(initial=0)))
        self.rows = self.whole.astype(np.float32)
        self.lists = np.ascontiguousarray(np.argsort(self.whole, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(self.whole.T, self.lists, axis=1))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of its k best but its own id, best first."""
        limit = self.biggest * max(int(queries.max(initial=0)), -int(queries.min(initial=0))) * queries.shape[1]
        if limit < 1 << 24:
            rows, asked = self.rows, queries.astype(np.float32)
        elif limit < 1 << 63:
            rows, asked = self.whole, queries
        else:
            rows, asked = self.whole.astype(object), queries.astype(object)
        for a in range(0, len(queries), TOGETHER):
            some = slice(a, a + TOGETHER)
            yield from self._top(rows, asked[some], queries[some], own[some], k)

    def _top(self, rows, asked, queries, own, k):
        together = None
        n = len(self.ids)
        for j, query in enumerate(queries):
            up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
            unseen, before, depth = np.ones(n, bool), 0, min(n, max(16, n // 48))
            at, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
            while True:
                now = np.zeros(n, bool)
                now[self.lists[up, n - depth : n - before]] = True
                now[self.lists[down, before:depth]] = True
                now &= unseen
                unseen &= ~now
                left = np.count_nonzero(unseen)
                if depth == n or LAST * left <= n:
                    now |= unseen
                    left = 0
                fresh = np.flatnonzero(now)
                if together is None and 4 * len(fresh) > n:
                    together = asked @ rows.T
                found = together[j, fresh] if together is not None else rows[fresh] @ asked[j]
                other = self.ids[fresh] != own[j]
                at, scores = np.concatenate((at, fresh[other])), np.concatenate((scores, found[other]))
                if len(at) > k:
                    least = sorted(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = np.flatnonzero(scores >= least)
                    at, scores = at[keep], scores[keep]
                if not left:
                    break
                best_left = np.concatenate((self.values[up, n - depth - 1], self.values[down, depth]))
                signed = np.concatenate((query[up], query[down]))
                bound = sum(map(int.__mul__, signed.tolist(), best_left.tolist())) if rows.dtype == object else int(signed @ best_left)
                if len(at) >= k and bound < scores.min():
                    break
                before, depth = depth, min(n, 2 * depth)
            # ids are in order, so a smaller place is a smaller id
            best = sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k]
            yield self.ids[at[best]], scores[best]


def usable(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite components, and not empty."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & (F.size(vector) > 0)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all vectors but those of its own id.

    Both tables have ``id`` long and ``v`` array of long. Only vectors of a
    query's length are its candidates; ids are taken as unique, a repeated row
    of one id counts as often as it is there. Sums are exact and ranked
    exactly up to 2^124; a score beyond 64 bits is given as the nearest long.
    """
    vectors = materialize(in_batches(vectors).select("id", "v"), "vectors")
    queries = materialize(queries.select("id", "v"), "queries")
    shards, blocks = -(-vectors.count() // shard_rows) or 1, -(-queries.count() // query_block) or 1
    part = lambda of, n: F.pmod(F.xxhash64("id", "v"), F.lit(of)).cast("int").alias(n)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dims = F.size("v").alias("d")
    cell = ["d", "shard", "block"]
    left = queries.select(dims, part(blocks, "block"), "id", "v", every(shards, "shard")).groupBy(*cell)
    right = vectors.select(dims, part(shards, "shard"), "id", "v", every(blocks, "block")).groupBy(*cell)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        def side(rows):
            rows = rows.select(["id", "v"]).combine_chunks()
            ids = rows.column("id").to_numpy()
            return ids, rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)

        (own, qs), (ids, vs) = side(asked), side(held)
        order = np.argsort(own, kind="stable")
        own, qs, found = own[order], qs[order], []
        # a shard of many rows of one id and vector is more than shard_rows
        for a in range(0, len(ids), 2 * shard_rows) if len(own) else ():
            shard = Shard(ids[a : a + 2 * shard_rows], vs[a : a + 2 * shard_rows])
            found += [(np.full(len(i), q), i, *halves(s)) for q, (i, s) in zip(own.tolist(), shard.top(qs, own, k), strict=True)]
        whole = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(4)]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "high", "low"), whole, strict=True)})

    found = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, high long, low long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")))
    most = F.lit((1 << 63) - 1)
    score = F.when(F.col("high") > 1, most).when(F.col("high") < -2, -most - 1).otherwise(F.shiftleft("high", 62) + F.col("low"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def embedding_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k best of each vector whose vec_id is divisible by ``every`` among all others, components taken as floor(scale * x). Vectors that are null, empty or have null, NaN or infinite components take no part, nor do rows without vec_id."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    vectors = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))
    return exact_top_k(vectors, vectors.where(F.pmod("id", F.lit(every)) == 0), k)
