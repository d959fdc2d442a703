"""Exact top-k search by inner product: tiled matrix products, partial selection in each tile, tree merging of top lists.

Vectors are quantised to integers, floor(scale * x), so that scores are exact. The candidates stay where they lie, in
shards that are the table's own partitions; they are not shuffled. The queries, a stated set, go to the tasks in chunks of
at most about ``CHUNK_BYTES``, broadcast one after the other. A task holds a chunk and streams its candidates through it:
a tile of ``CANDIDATE_TILE`` candidates and ``QUERY_TILE`` queries is one matrix product, of which each query keeps the k
best by (score descending, id ascending), merged with its best so far. The lists of the tasks are merged ``FAN_IN`` at a
time until one is left for each query.

Products run in the narrowest floating-point numbers in which every score is a whole number; values so large that a score
could reach 2^53 are refused.

Defined cases: rows with a null id, a null vector, or null or non-finite components take no part; vectors of other
lengths count as filled up with zeros; a query never meets rows of its own id; repeated candidate rows are listed once
each; a repeated query id is asked once, with its smallest vector; a query with fewer than k candidates lists them all;
an empty table gives an empty result; other columns are ignored.

Scale: the candidates are read once for each chunk of queries, which is what the products cost too; what is shuffled are
k entries for each query and task. A task's memory is a chunk of queries, their top lists and one tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.io import staged_all
from quillon.llm.common import staged
from quillon.llm.text_arrays import releasing

K = 20
SCALE = 64
CANDIDATE_TILE = 2048
QUERY_TILE = 512
CHUNK_BYTES = 16_000_000
FAN_IN = 16
_LISTS = "query_id long, tile int, best array<struct<cost:long,vec_id:long>>"


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of whole doubles) of the rows that take part."""
    x = F.col(embedding)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double")).alias("v")
    )


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _tile(q_ids, q, c_ids, c, k):
    """For each query its k best candidates of the tile (ids ascend): scores and ids, best first, and which are real."""
    scores = (q @ c.T).astype(np.float64)
    own = q_ids[:, None] == c_ids[None, :]
    k = min(k, c.shape[0])
    if np.abs(scores).max(initial=0) * c.shape[0] < 2**52:  # score and place in one exact number
        rank = scores * c.shape[0] - np.arange(c.shape[0])
        rank[own] = -np.inf
        best = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(rank, best, 1), axis=1), 1)
    else:
        scores = np.where(own, -np.inf, scores)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, best, 1), c_ids[best], ~np.take_along_axis(own, best, 1)


class TopLists:
    """The k best so far of each query of a chunk."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.costs = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)  # negative scores; the largest number marks a free place
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(c_ids, kind="stable")
        c_ids, c = c_ids[order], c[order]
        for a in range(0, len(self.ids), QUERY_TILE):
            rows = slice(a, a + QUERY_TILE)
            scores, ids, real = _tile(self.ids[rows], self.queries[rows], c_ids, c, self.k)
            costs = np.concatenate([self.costs[rows], _costs(scores, real)], 1)
            ids = np.concatenate([self.found[rows], ids], 1)
            by_id = np.argsort(ids, axis=1, kind="stable")
            by_cost = np.argsort(np.take_along_axis(costs, by_id, 1), axis=1, kind="stable")
            best = np.take_along_axis(by_id, by_cost, 1)[:, : self.k]
            self.costs[rows], self.found[rows] = np.take_along_axis(costs, best, 1), np.take_along_axis(ids, best, 1)

    def batches(self, tile: int, size: int = 5000):
        for a in range(0, len(self.ids), size):
            costs, found = self.costs[a : a + size], self.found[a : a + size]
            real = costs != np.iinfo(np.int64).max
            ends = pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(costs[real]), pa.array(found[real])], ["cost", "vec_id"]))
            ids = self.ids[a : a + size]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), tile, np.int32)), lists], ["query_id", "tile", "best"])


def _costs(scores: np.ndarray, real: np.ndarray) -> np.ndarray:
    out = np.full(scores.shape, np.iinfo(np.int64).max, np.int64)
    out[real] = -scores[real].astype(np.int64)
    return out


def _lists(candidates: DataFrame, sent, width: int, kind, k: int) -> DataFrame:
    """The k best of each query of a chunk (ids and vectors, broadcast) in each partition of the candidates."""

    def run(batches):
        lists = None
        for batch in batches:
            for a in range(0, len(batch), CANDIDATE_TILE):
                part = batch.slice(a, CANDIDATE_TILE)
                lists = lists or TopLists(*sent.value, k)
                lists.meet(np.asarray(part.column("vec_id"), np.int64), _matrix(part.column("v"), width, kind))
        if lists:
            yield from lists.batches(TaskContext.get().partitionId())

    return candidates.mapInArrow(releasing(run), _LISTS)


def search(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    spark, candidates = vectors.sparkSession, quantised(vectors, vec_id, embedding, scale)
    asked = quantised(vectors.where(is_query), vec_id, embedding, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    largest = F.aggregate("v", F.lit(0.0), lambda m, e: F.greatest(m, F.abs(e)))
    most = candidates.agg(F.max(largest).alias("value"), F.max(F.size("v")).alias("width")).first()
    value, width = most["value"] or 0.0, most["width"] or 0
    if value * value * width >= 2**53:
        raise ValueError("components are too large for exact scores")
    kind = np.float32 if value * value * width < 2**24 else np.float64
    if value < 2**15:
        narrow = lambda df: df.withColumn("v", F.col("v").cast("array<smallint>"))
        candidates, asked = narrow(candidates), narrow(asked)
    asked = staged(asked, "queries")
    n_chunks = -(-asked.count() * max(width, 2 * k) * np.dtype(kind).itemsize // CHUNK_BYTES)
    if not n_chunks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def found():
        for n in range(n_chunks):
            chunk = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)) == n).toArrow()
            if len(chunk):
                sent = spark.sparkContext.broadcast((np.asarray(chunk.column("vec_id"), np.int64), _matrix(chunk.column("v").combine_chunks(), width, kind)))  # about CHUNK_BYTES
                yield _lists(candidates, sent, width, kind, k)
                sent.unpersist()  # its lists are written

    lists = staged_all(found(), spark, _LISTS, "top-lists")
    left = (lists.agg(F.max("tile")).first()[0] or 0) + 1  # tiles have the numbers of the tasks' partitions
    while True:
        lists = lists.groupBy("query_id", F.floor(F.col("tile") / FAN_IN).cast("int").alias("tile")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if (left := -(-left // FAN_IN)) <= 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.cost")).alias("score")
    )
