"""Titles as vectors of hashed character trigrams, and the most similar rows by cosine."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haggle.sources.storage import shared_folder

DIMENSIONS = 1024


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of a text: lower case, two blanks before a word and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def bucket(gram: Column, dimensions: int = DIMENSIONS) -> Column:
    """The place 1..dimensions of a trigram: the first 32 bits of its MD5 as a signed number, without sign, modulo dimensions."""
    unsigned = F.conv(F.substring(F.md5(gram.cast("binary")), 1, 8), 16, 10).cast("long")
    return (F.abs(F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)) % dimensions + 1).cast("int")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: an array of one holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entries(text: Column) -> Column:
    """The entries of a text's vector in order of place: array of (bucket, weight), of unit length together. All of it is worked out in the row."""
    hits = F.transform(trigrams(text), lambda g: bucket(g))

    def counted(h: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(h)), lambda b: F.struct(b.alias("bucket"), F.size(F.filter(h, lambda x: x == b)).cast("double").alias("n")))

    def weighted(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["n"] * x["n"]))
        return _once(norm, lambda r: F.transform(counts, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / r).alias("weight"))))

    return _once(hits, lambda h: _once(counted(h), weighted))


def buckets(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The vectors of texts as their entries: id, bucket, weight (unit length together). Null texts have none."""
    return rows.select(id_col, F.inline(entries(F.col(text_col))))


def dense(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The vector of a text as an array of floats: zeros for a text without words, null for null."""
    edge = lambda b: F.struct(F.lit(b).alias("bucket"), F.lit(0.0).alias("weight"))

    def filled(e: Column) -> Column:
        # each entry after the zeros that lead up to it, and the zeros after the last
        before = F.concat(F.array(edge(0)), e)
        up_to = F.zip_with(before, F.concat(e, F.array(edge(dimensions + 1))), lambda a, b: F.concat(F.array_repeat(F.lit(0.0), b["bucket"] - a["bucket"] - 1), F.array(b["weight"])))
        return F.slice(F.flatten(up_to), F.lit(1), F.lit(dimensions)).cast("array<float>")

    return F.when(text.isNotNull(), F.get(F.transform(F.array(entries(text)), filled), F.lit(0)))


#: Query vectors that one scan carries, rows that a task compares with them at once, shared entries that it multiplies at once, and ids of rows that are put together at once.
QUERY_BLOCK, _ROWS, _SHARED, _TOGETHER = 2048, 1024, 1 << 22, 1 << 19


def staged_folder(spark: SparkSession) -> str:
    """A new folder for a table that is written in parts."""
    return f"{shared_folder(spark)}/similar-{uuid.uuid4().hex}"


def classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of one text put together: number (of the class), deal, ids (in order, each once), e (the entries). Written once; rows without an id or without a trigram are in none.

    A large table is dealt by a hash of the id into parts of about _TOGETHER rows, and rows are put together within one, so no class and no deal grows with the table.
    """
    spark, folder = rows.sparkSession, staged_folder(rows.sparkSession)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    n = max(1, own.count())
    deal = F.pmod(F.xxhash64("id"), F.lit(-(-n // _TOGETHER))).cast("int")
    together = own.groupBy(deal.alias("deal"), "text").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    spread = together.repartition(max(-(-n // (1 << 16)), min(-(-n // 1024), spark.sparkContext.defaultParallelism)))
    spread.select(F.monotonically_increasing_id().alias("number"), "deal", "ids", entries(F.col("text")).alias("e")).where("size(e) > 0").write.parquet(folder)
    return spark.read.schema("number long, deal int, ids array<long>, e array<struct<bucket: int, weight: double>>").parquet(folder)


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as the number of entries of each, and the bucket and weight of every entry."""
    flat = column.flatten()
    return pc.list_value_length(column).to_numpy(zero_copy_only=False), flat.field("bucket").to_numpy(), flat.field("weight").to_numpy()


def stretches(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], .., begin[0] + n[0] - 1, begin[1], ..: the places of stretches of so many."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def heads(ids: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Of lists of n ids each, one after the other, the first `most` as the rows of a matrix, filled up with -1, and in a last column how many these are."""
    few = np.minimum(n, most)
    out = np.full((len(n), most + 1), -1, np.int64)
    out[:, most] = few
    out[np.repeat(np.arange(len(n)), few), stretches(np.zeros(len(n), np.int64), few)] = ids[stretches(np.cumsum(n) - n, few)]
    return out


def best_ids(query: np.ndarray, head: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of classes found for queries (their heads) the ids, at most so many a query, best first: query, id, score."""
    few = head[:, -1]
    query, score, place = np.repeat(query, few), np.repeat(score, few), head[np.repeat(np.arange(len(head)), few), stretches(np.zeros(len(head), np.int64), few)]
    order = np.lexsort((place, -score, query))
    query, place, score = query[order], place[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < most
    return query[keep], place[keep], score[keep]


def query_blocks(asked: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Classes of queries in blocks of about so many: numbers, and their vectors as `sparse` gives them."""
    n = -(-max(1, asked.count()) // block)
    for b in range(n):
        own = asked.where(F.pmod(F.xxhash64("number"), F.lit(n)) == b).select("number", "e").toArrow().combine_chunks()
        if own.num_rows:
            yield (own.column("number").to_numpy(), *sparse(own.column("e").combine_chunks()))


def ranked(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query row from the k + 1 best of its class (number, id, similarity), of which one may be the query itself: query_id, rank, id, similarity and what else found has."""
    best = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("similarity"), "id"))
    few = found.withColumn("rank", best).where(F.col("rank") <= k + 1).drop("rank")
    pairs = asked.select("number", F.explode("ids").alias("query_id")).join(few, "number").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", *(c for c in found.columns if c != "number"))


class _Asked:
    """A block of queries by bucket. What many of them hold is a dense matrix with few columns, the other entries are postings: where a bucket's begin, and of each the query's number and weight."""

    def __init__(self, number: np.ndarray, size: np.ndarray, bucket: np.ndarray, weight: np.ndarray):
        self.number, of = number, np.repeat(np.arange(len(number)), size)
        held = np.bincount(bucket, minlength=DIMENSIONS + 1)
        common = held > max(4, len(number) // 16)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        dense = common[bucket]
        self.dense = np.zeros((len(number), int(common.sum())))
        self.dense[of[dense], self.column[bucket[dense]]] = weight[dense]
        of, bucket, weight = of[~dense], bucket[~dense], weight[~dense]
        order = np.argsort(bucket, kind="stable")
        self.begin = np.searchsorted(bucket[order], np.arange(DIMENSIONS + 2))
        self.of, self.weight = of[order], weight[order]

    def products(self, size: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The similarity of each query (down) to each of some rows (across)."""
        row, column, n = np.repeat(np.arange(len(size)), size), self.column[bucket], self.begin[bucket + 1] - self.begin[bucket]
        dense = np.zeros((len(size), self.dense.shape[1]))
        dense[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        out = self.dense @ dense.T
        take = stretches(self.begin[bucket], n)
        if len(take):
            out += np.bincount(self.of[take] * len(size) + np.repeat(row, n), self.weight[take] * np.repeat(weight, n), out.size).reshape(out.shape)
        return out

    def cuts(self, size: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int]]:
        """Rows in stretches that share at most about _SHARED entries of postings with the queries."""
        up_to = np.concatenate([[0], np.cumsum(self.begin[bucket + 1] - self.begin[bucket])])[np.concatenate([[0], np.cumsum(size)])]
        at = 0
        while at < len(size):
            end = int(np.searchsorted(up_to, up_to[at] + _SHARED, "right")) - 1
            end = max(at + 1, min(end, at + _ROWS))
            yield at, end
            at = end


def _best(queries: Broadcast, most: int):
    """mapInArrow function over (ids, e): the ids of a partition most similar to each query, at most so many, and none without a bucket in common.

    Only what may be among a query's best is rounded and sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(*queries.value)
        n = len(asked.number)
        query, head, score = np.zeros(0, np.int64), np.zeros((0, most + 1), np.int64), np.zeros(0)
        least, last = np.zeros(n), np.full(n, np.iinfo(np.int64).max)
        for batch in batches:
            size, bucket, weight = sparse(batch.column("e"))
            own = heads(batch.column("ids").flatten().to_numpy(), pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False), most)
            ends = np.concatenate([[0], np.cumsum(size)])
            for at, end in asked.cuts(size, bucket):
                part = slice(ends[at], ends[end])
                found = asked.products(size[at:end], bucket[part], weight[part])
                floor = least
                if end - at > most and not least.all():
                    floor = np.maximum(least, np.partition(found, -most, axis=1)[:, -most])
                q, c = np.nonzero(found >= np.maximum(floor - 2e-6, 4e-7)[:, None])
                s, first = np.round(found[q, c], 6), own[at + c, 0]
                keep = (s > 0) & ((s > least[q]) | ((s == least[q]) & (first < last[q])))
                if not keep.any():
                    continue
                query, head, score = np.concatenate([query, q[keep]]), np.concatenate([head, own[at + c[keep]]]), np.concatenate([score, s[keep]])
                order = np.lexsort((head[:, 0], -score, query))
                rank = np.arange(len(query)) - np.searchsorted(query[order], query[order])
                order = order[rank < most]
                query, head, score, rank = query[order], head[order], score[order], rank[rank < most]
                full = rank == most - 1
                least[query[full]], last[query[full]] = score[full], head[full, 0]
        query, place, score = best_ids(query, head, score, most)
        yield pa.RecordBatch.from_arrays([pa.array(asked.number[query]), pa.array(place), pa.array(score)], names=["number", "id", "similarity"])

    return run


def similar_titles(rows: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows most similar to each query row: query_id, rank, id, similarity (6 digits; ties: the smaller id). Ids are keys: one that rows of equal text share counts once.

    Rows of one text are compared once, and so are queries of one text. Query vectors go out in blocks of about `block`; every partition compares its vectors with a block and
    gives k + 1 rows for each, which are written before the next block goes out. A row that shares no bucket with a query, and the query itself, is no result.
    """
    spark, found = rows.sparkSession, staged_folder(rows.sparkSession)
    schema = "number long, id long, similarity double"
    known, asked = classes(rows, id_col, text_col), classes(queries, id_col, text_col)
    spark.createDataFrame([], schema).write.parquet(found)
    for own in query_blocks(asked, block):
        shared = spark.sparkContext.broadcast(own)
        known.select("ids", "e").mapInArrow(_best(shared, k + 1), schema).write.mode("append").parquet(found)
        shared.unpersist()
    return ranked(spark.read.schema(schema).parquet(found), asked, k).withColumnRenamed("id", id_col)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def similar_vectors(rows: DataFrame, query: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """The k rows nearest to one query vector by cosine: id, similarity (6 digits; ties: the smaller id).

    query is one row with column q; without it there is no result. Every task keeps its k best; no full sort.
    """
    v = unit(F.transform(vector_col, lambda x: x.cast("double")))
    asked = query.select(unit(F.transform("q", lambda x: x.cast("double"))).alias("q")).head(1)
    q = F.array(*map(F.lit, asked[0].q)) if asked else F.array().cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.lit(bool(asked))).select(id_col, F.round(dot, 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)
