"""Exact k nearest by inner product with a vector-approximation file.

Each dimension's range is cut into 64 cells. The file holds one byte for each component beside the exact
vectors. A search first scans cells only: they bound every inner product from both sides, and the k best lower
bounds over all partitions give each query a floor. Then every partition takes what can reach the floor in the order
of its upper bounds and reads exact vectors, in growing waves, until no unread one can reach the partition's
k-th score. A partition so gives k rows for a query at most, and the best k of these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CELLS = 64
#: Components of the queries that one scan carries, about: 16,384 queries of 64 components.
QUERY_COMPONENTS = 1 << 20
#: Candidates and queries that a task compares at once.
_ROWS, _QUERIES = 1024, 1024


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(256 x) of each component. Vectors null or with null or non-finite components go."""
    fit = F.expr("not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & fit).select("vec_id", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _edges(dims: int):
    """mapInArrow function over (v): the least and the greatest of each component in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dims)
                least, most = v.min(axis=0), v.max(axis=0)
                low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    return run


def _encode(low: np.ndarray, width: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.clip((_matrix(batch.column("v"), len(low)) - low) // width, 0, CELLS - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in cells], pa.binary()), batch.column("v")], names=["vec_id", "cells", "v"])

    return run


class _Queries:
    """Queries with the bounds that cells put on their inner products."""

    def __init__(self, low: np.ndarray, width: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.low, self.width, self.ids, self.vectors = low, width, ids, vectors
        self.up, self.down = np.maximum(vectors, 0).astype(np.float64), np.minimum(vectors, 0).astype(np.float64)

    def parts(self) -> Iterator[slice]:
        for at in range(0, len(self.ids), _QUERIES):
            yield slice(at, at + _QUERIES)

    def box(self, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        least = self.low + np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), len(self.low)).astype(np.float64) * self.width
        return least, least + self.width - 1

    def lower(self, q: slice, least, most, own: np.ndarray) -> np.ndarray:
        found = self.up[q] @ least.T + self.down[q] @ most.T
        found[self.ids[q, None] == own] = -np.inf
        return found

    def upper(self, q: slice, least, most, own: np.ndarray) -> np.ndarray:
        found = self.up[q] @ most.T + self.down[q] @ least.T
        found[self.ids[q, None] == own] = -np.inf
        return found


def _scan(shared, k: int):
    """mapInArrow function over (vec_id, cells): the k best lower bounds of a partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Queries = shared.value
        best = np.full((len(asked.ids), k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                own = part.column("vec_id").to_numpy()
                least, most = asked.box(part.column("cells").to_pylist())
                for q in asked.parts():
                    both = np.concatenate([best[q], asked.lower(q, least, most, own)], axis=1)
                    best[q] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        q, c = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, c])], names=["q", "lower"])

    return run


def _read(shared, k: int):
    """mapInArrow function over (vec_id, cells, v): the k best of a partition for each query, by score, then smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = shared.value
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked.ids]  # scores and ids so far
        kth = floor.copy()  # what a candidate must reach
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                own, exact = part.column("vec_id").to_numpy(), None
                least, most = asked.box(part.column("cells").to_pylist())
                for cut in asked.parts():
                    upper = asked.upper(cut, least, most, own)
                    able = (upper >= kth[cut, None]) & np.isfinite(upper)
                    for i in np.flatnonzero(able.any(axis=1)).tolist():
                        q = cut.start + i
                        waiting = np.flatnonzero(able[i])
                        waiting = waiting[np.argsort(-upper[i, waiting], kind="stable")]
                        if exact is None:
                            exact = _matrix(part.column("v"), len(asked.low))
                        done, size = 0, 2 * k
                        while done < len(waiting) and upper[i, waiting[done]] >= kth[q]:
                            wave = waiting[done : done + size]
                            scores = np.concatenate([top[q][0], exact[wave] @ asked.vectors[q]])
                            ids = np.concatenate([top[q][1], own[wave]])
                            order = np.lexsort((ids, -scores))[:k]
                            top[q] = scores[order], ids[order]
                            if len(order) == k:
                                kth[q] = max(kth[q], scores[order[-1]])
                            done, size = done + size, size * 4
        for q, (scores, ids) in enumerate(top):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), asked.ids[q])), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, query_components: int = QUERY_COMPONENTS) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    vectors: rows of quantised(); is_query: which of them are queries; all others but the query's own id are
    candidates. Equal scores go to the smaller vec_id. A shorter vector counts as filled up with zeros, so products
    are over the components that both have, and an empty vector scores 0. Repeated rows of one id are
    candidates each for itself, and one query (the least of its vectors). A null id is no query. With
    fewer than k candidates all are returned; empty tables give nothing. Components must be below 2^24 in size,
    so that sums are exact. Each scan of the file carries query_components / components queries.
    """
    spark = vectors.sparkSession
    vectors = staged(vectors, "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = vectors.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return none
    edge = vectors.select("v").mapInArrow(_edges(dims), "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    low = np.array([r.low for r in edge], np.int64)
    width = np.array([(r.high - r.low) // CELLS + 1 for r in edge], np.int64)
    file = staged(vectors.mapInArrow(_encode(low, width), "vec_id long, cells binary, v array<long>"), "cells")
    query_rows = staged(vectors.where(is_query & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = -(-query_rows.count() * max(1, dims) // query_components)
    numbered = query_rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    results = none
    for b in range(blocks):
        own = numbered.where(F.col("block") == b).select("vec_id", "v").toArrow().combine_chunks()
        if own.num_rows:
            ids = own.column("vec_id").to_numpy()
            order = np.argsort(ids)
            asked = _Queries(low, width, ids[order], _matrix(own.column("v").combine_chunks(), dims)[order])
            results = results.union(_block_top_k(file, asked, k))
    return results


def _block_top_k(file: DataFrame, asked: _Queries, k: int) -> DataFrame:
    """The result of one block of queries. What is sent about here has a few rows for each query of the block."""
    context = file.sparkSession.sparkContext
    bounds = file.select("vec_id", "cells").where("vec_id is not null").mapInArrow(_scan(context.broadcast(asked), k), "q int, lower double")
    # partitions give k bounds each, so a query has k rows a partition here
    by_bound = Window.partitionBy("q").orderBy(F.desc("lower"))
    floors = bounds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") == k).select("q", "lower").toArrow()
    floor = np.full(len(asked.ids), -np.inf)
    floor[floors.column("q").to_numpy()] = floors.column("lower").to_numpy()
    found = file.where("vec_id is not null").mapInArrow(_read(context.broadcast((asked, floor)), k), "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return staged(best.select("query_id", "rank", "vec_id", "score"), "best")
