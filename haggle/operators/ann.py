"""An approximate index of titles: for each part of the table a navigable small-world graph over its vectors.

A node has links to near nodes on each of its layers; layers thin out upwards. A search goes down greedily, then keeps the best `ef` on
the lowest layer, so it reads some hundred vectors of a part, not all. Parts are built and searched by themselves, each in a task;
a part is one row of the index, whose size the number of vectors in a part and of ids in a deal (see vectors.classes) bounds.
Building finds the nearest of all nodes before a new one by products of matrices, not by a search of the graph, and searches take a step for all queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.operators.vectors import DIMENSIONS, QUERY_BLOCK, best_ids, classes, heads, query_blocks, ranked, sparse, staged_folder, stretches
from haggle.sources.storage import Versions

#: Links of a node on a layer (twice as many on the lowest), nodes looked at while building, and vectors of a part (whose similarities are a matrix of 4 bytes a pair while it is built).
M, EF_BUILD, PART = 16, 64, 8192
#: Rows that are worked on at once while building, and entries of vectors while searching.
_ROWS, _READ = 512, 1 << 22
_INDEX = "part int, ids array<long>, copies array<int>, size array<int>, bucket array<int>, weight array<float>, layers array<int>, degree array<int>, links array<int>"
_FOUND = "number long, id long, similarity double, n_read long"


def _spread(alike: np.ndarray, near: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Of each node's near ones (a row, nearest first, filled up with -1; own: their similarity) at most so many: those first that are nearer to the node than to
    one chosen already, then the nearest of the others."""
    n, wide = near.shape
    there = near >= 0
    chosen, count, closest = np.zeros((n, wide), bool), np.zeros(n, int), np.full((n, wide), -np.inf, np.float32)
    for t in range(wide):
        rows = np.flatnonzero(there[:, t] & (count < most) & (closest[:, t] < own[:, t]))
        if not len(rows):
            continue
        chosen[rows, t] = True
        count[rows] += 1
        closest[rows, t + 1 :] = np.maximum(closest[rows, t + 1 :], alike[near[rows, t, None], near[rows, t + 1 :]])
    turn = np.where(there, np.arange(wide) + wide * ~chosen, 2 * wide)
    order = np.argsort(turn, axis=1)[:, :most]
    return np.where(np.take_along_axis(turn, order, 1) < 2 * wide, np.take_along_axis(near, order, 1), -1)


class Graph:
    """Vectors of unit length (sparse: entries of each, and the bucket and weight of every entry) and the links between them: for each layer, lowest first, a row a node, filled up with -1."""

    def __init__(self, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], height: np.ndarray, layers: list[np.ndarray]):
        self.size, self.bucket, self.weight = vectors
        self.begin = np.cumsum(self.size) - self.size
        self.height, self.layers = height, layers
        self.top = int(np.argmax(height)) if len(height) else None

    @property
    def links(self) -> list[list[list[int]]]:
        """links[node][layer]"""
        return [[layer[i][layer[i] >= 0].tolist() for layer in self.layers[: self.height[i]]] for i in range(len(self.height))]

    def similar(self, queries: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The similarity of query q[i] (a row of a dense matrix) and node[i]."""
        n = self.size[node]
        at = stretches(self.begin[node], n)
        return np.add.reduceat(queries[np.repeat(q, n), self.bucket[at] - 1] * self.weight[at], np.cumsum(n) - n)

    def near(self, queries: np.ndarray, start: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ef nodes of a layer that a search from start (a node a query) finds, best first, filled up with -1; their similarity; how many nodes were read. All queries go a step at once."""
        links, every = self.layers[layer], np.arange(len(queries))
        best, waiting = np.full((len(queries), ef), -1), np.zeros((len(queries), ef), bool)
        score = np.full((len(queries), ef), -np.inf, queries.dtype)
        best[:, 0], score[:, 0], waiting[:, 0] = start, self.similar(queries, every, start), True
        seen, read = np.zeros((len(queries), len(self.size)), bool), np.ones(len(queries), int)
        seen[every, start] = True
        active = every
        while len(active):
            place = np.argmax(waiting[active], axis=1)  # the best one that waits, as they are in order
            waiting[active, place] = False
            to = links[best[active, place]]
            new = (to >= 0) & ~seen[active[:, None], to]
            row, column = np.nonzero(new)
            if len(row):
                q, node = active[row], to[row, column]
                seen[q, node] = True
                read[active] += new.sum(axis=1)
                own = np.full(to.shape, -np.inf, score.dtype)
                own[row, column] = self.similar(queries, q, node)
                scores = np.concatenate([score[active], own], axis=1)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :ef]
                score[active] = np.take_along_axis(scores, order, 1)
                best[active] = np.take_along_axis(np.concatenate([best[active], np.where(new, to, -1)], axis=1), order, 1)
                waiting[active] = np.take_along_axis(np.concatenate([waiting[active], new], axis=1), order, 1)
            active = active[waiting[active].any(axis=1)]
        return best, score, read

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near on the lowest layer, from the best node of the layers above it."""
        start, above = np.full(len(queries), self.top), 0
        for layer in range(len(self.layers) - 1, 0, -1):
            found, _, read = self.near(queries, start, layer, 1)
            start, above = found[:, 0], above + read
        best, score, read = self.near(queries, start, 0, ef)
        return best, score, read + above

    @classmethod
    def build(cls, vectors: np.ndarray, height: np.ndarray, m: int, ef: int) -> Graph:
        """height: of each node the number of layers it is on. Each node is linked, on each of its layers, with up to m of the ef nearest of those before it; a node with
        too many links keeps m (on the lowest layer 2 m) of its ef nearest."""
        n, layers = len(vectors), []
        alike = np.empty((n, n), np.float32)
        for a in range(0, n, _ROWS):
            alike[a : a + _ROWS, : a + _ROWS] = vectors[a : a + _ROWS] @ vectors[: a + _ROWS].T
            alike[:a, a : a + _ROWS] = alike[a : a + _ROWS, :a].T
        for layer in range(int(height.max(initial=0))):
            nodes, most = np.flatnonzero(height > layer), m if layer else 2 * m
            pairs = [np.zeros((2, 0), int)]
            for a in range(1, len(nodes), _ROWS):
                new = nodes[a : a + _ROWS]
                own = np.where(nodes[None, : a + len(new)] < new[:, None], alike[new[:, None], nodes[: a + len(new)]], -np.inf)
                few = np.argpartition(-own, ef, axis=1)[:, :ef] if own.shape[1] > ef else np.broadcast_to(np.arange(own.shape[1]), own.shape)
                few = np.take_along_axis(few, np.argsort(-np.take_along_axis(own, few, 1), axis=1, kind="stable"), 1)
                own = np.take_along_axis(own, few, 1)
                to = _spread(alike, np.where(own > -np.inf, nodes[few], -1), own, m)
                pairs.append(np.stack([np.repeat(new, to.shape[1]), to.ravel()])[:, to.ravel() >= 0])
            one, two = np.concatenate(pairs, axis=1)
            one, two = np.concatenate([one, two]), np.concatenate([two, one])
            order = np.lexsort((two, -alike[one, two], one))
            one, two = one[order], two[order]
            rank = np.arange(len(one)) - np.searchsorted(one, one)
            wide = max(ef, most)
            near = np.full((n, wide), -1)
            near[one[rank < wide], rank[rank < wide]] = two[rank < wide]
            links = np.full((n, most), -1)
            for a in range(0, n, _ROWS):
                some = near[a : a + _ROWS]
                links[a : a + _ROWS] = _spread(alike, some, alike[np.arange(a, a + len(some))[:, None], some], most)
            layers.append(links)
        bucket = np.nonzero(vectors)
        return cls((np.bincount(bucket[0], minlength=n), bucket[1] + 1, vectors[bucket]), height, layers)


def _dense(size: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), DIMENSIONS), np.float32)
    out[np.repeat(np.arange(len(size)), size), bucket - 1] = weight
    return out


def graphs(rows: DataFrame, id_col: str, text_col: str, m: int = M, ef: int = EF_BUILD, part: int = PART) -> DataFrame:
    """The index of texts, a row for each part of about `part` vectors. Rows without an id or without a trigram are not in it; rows of one text (see vectors.classes) are one node with all their ids."""
    nodes = classes(rows, id_col, text_col)
    count, deals = nodes.agg(F.count("*"), F.coalesce(F.max("deal"), F.lit(0)) + 1).first()
    per = max(1, -(-count // (deals * part)))
    own = nodes.select((F.col("deal") * per + F.pmod(F.xxhash64("number"), F.lit(per))).cast("int").alias("part"), "ids", "e")

    def build(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        batch = batch.take(pc.sort_indices(pc.list_element(batch.column("ids"), 0))).combine_chunks()
        ids, vectors = batch.column("ids").combine_chunks(), sparse(batch.column("e").combine_chunks())
        # one node in m on the layer above, drawn by place so that the same rows give the same graph
        height = 1 + np.floor(-np.log(1 - np.random.default_rng(len(ids)).random(len(ids))) / np.log(m)).astype(int)
        graph = Graph.build(_dense(*vectors), height, m, ef)
        degree = np.concatenate([(layer >= 0).sum(axis=1) for layer in graph.layers])
        links = np.concatenate([layer[layer >= 0] for layer in graph.layers])
        columns = [ids.flatten(), pc.list_value_length(ids), *vectors, height, degree, links]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.ListArray.from_arrays([0, len(c)], (c if isinstance(c, pa.Array) else pa.array(c)).cast(k)) for c, k in zip(columns, kinds, strict=True)]
        return pa.table([batch.column("part")[:1], *arrays], names=["part", "ids", "copies", "size", "bucket", "weight", "layers", "degree", "links"])

    return own.groupBy("part").applyInArrow(build, _INDEX)


def _search(queries, most: int, ef: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, *asked = queries.value
        asked = _dense(*asked)
        for batch in batches:
            for p in range(batch.num_rows):
                ids, copies, size, bucket, weight, height, degree, links = (batch.column(c)[p].values.to_numpy() for c in ("ids", "copies", "size", "bucket", "weight", "layers", "degree", "links"))
                degree = degree.reshape(-1, len(size))
                layers, ends = [], np.concatenate([[0], np.cumsum(degree.sum(axis=1))])
                for k, own in enumerate(degree):
                    layers.append(np.full((len(size), max(1, own.max())), -1))
                    layers[k][np.arange(layers[k].shape[1]) < own[:, None]] = links[ends[k] : ends[k + 1]]
                graph, head = Graph((size, bucket, weight), height, layers), heads(ids, copies, most)
                step = max(16, _READ // (layers[0].shape[1] * int(size.max())))
                for at in range(0, len(number), step):
                    best, score, read = graph.search(asked[at : at + step], max(ef, most))
                    score = np.round(score.astype(np.float64), 6)
                    query, place = np.nonzero((best >= 0) & (score > 0))
                    query, place, score = best_ids(query, head[best[query, place]], score[query, place], most)
                    # how much was read for a query stands in a row of its own
                    none, n = pa.nulls(len(read)), len(query)
                    columns = [np.concatenate([query, np.arange(len(read))]) + at, [pa.array(place), none.cast(pa.int64())], [pa.array(score), none.cast(pa.float64())], np.concatenate([np.zeros(n, int), read])]
                    yield pa.RecordBatch.from_arrays([pa.array(number[columns[0]]), pa.concat_arrays(columns[1]), pa.concat_arrays(columns[2]), pa.array(columns[3])], names=["number", "id", "similarity", "n_read"])

    return run


def nearest(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, ef: int = 16) -> DataFrame:
    """About the k rows most similar to each query row: query_id, rank, id, similarity (6 digits; ties: the smaller id), n_read (vectors read for the query, over all parts).

    Every part is searched for every query text, a block of them at a time, and gives k + 1 rows. A query is no result of its own; rows without a trigram in common are none.
    """
    spark, folder = index.sparkSession, staged_folder(index.sparkSession)
    asked = classes(queries, id_col, text_col)
    spark.createDataFrame([], _FOUND).write.parquet(folder)
    for own in query_blocks(asked, QUERY_BLOCK):
        shared = spark.sparkContext.broadcast(own)
        index.mapInArrow(_search(shared, k + 1, ef), _FOUND).write.mode("append").parquet(folder)
        shared.unpersist()
    found = spark.read.schema(_FOUND).parquet(folder)
    read = found.groupBy("number").agg(F.sum("n_read").alias("n_read"))
    return ranked(found.where("id is not null").drop("n_read").join(read, "number"), asked, k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row (n_queries, recall): the share of the exact results' places (query_id, similarity) that found fills. Rows as similar as
    the last exact one stand for one another, so a result counts by its similarity, to within a rounded digit."""
    wanted = exact.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
    hits = found.join(wanted.select("query_id", "least"), "query_id").where(F.col("similarity") >= F.col("least") - 2e-6).groupBy("query_id").agg(F.count("*").alias("hits"))
    return wanted.join(hits, "query_id", "left").agg(F.count("*").alias("n_queries"), (F.sum(F.least("n", F.coalesce("hits", F.lit(0)))) / F.sum("n")).alias("recall"))


class TitleIndex:
    """The index of a table of versions, kept beside it: one for each version that it was built for."""

    def __init__(self, spark: SparkSession, versions: Versions, id_col: str, text_col: str):
        self.spark, self.versions, self.id_col, self.text_col = spark, versions, id_col, text_col

    def _path(self, version: int) -> str:
        return f"{self.versions.path}/index-of-{self.text_col}/v{version}"

    def build(self, version: int | None = None, **how) -> int:
        """Index a version (the newest without one); what is there of an attempt before is replaced."""
        version = self.versions.latest() if version is None else version
        graphs(self.versions.read(version), self.id_col, self.text_col, **how).write.mode("overwrite").parquet(self._path(version))
        return version

    def nearest(self, queries: DataFrame, k: int, version: int, **how) -> DataFrame:
        index = self.spark.read.schema(_INDEX).parquet(self._path(version))
        return nearest(index, queries, self.id_col, self.text_col, k, **how)
