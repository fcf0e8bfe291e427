"""What the operators of this package share: reading, staging, joins with hot keys and link components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces between words everywhere in this package: blank and \t \n \v \f \r.
BLANKS = r"\x20\x09-\x0D"
#: A key is hot if it holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Under a local master, where none is set, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="haggle-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage and freezes ids that depend on the layout of partitions; the table outlives
    the executors that wrote it, until clear() or unstage() removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    _written.remove(df.staged_at)
    _remove(df.sparkSession, df.staged_at)


def mark() -> int:
    """How many staged tables there are, for clear()."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the tables staged since a mark, but for one: for use when the results that read them are written."""
    stays = keep.staged_at if keep is not None else None
    for path in _written[since:]:
        if path != stays:
            _remove(spark, path)
    _written[since:] = [p for p in _written[since:] if p == stays]


_kept: dict[int, tuple] = {}


def kept(shared: Broadcast, make: Callable):
    """What make makes of a broadcast value, kept by this worker from task to task; only the latest is."""
    value = shared.value
    if id(value) not in _kept:
        _kept.clear()
        _kept[id(value)] = (value, make(value))
    return _kept[id(value)][1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes (one row at least), so that whatever is made of a part is small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > most_bytes and batch.slice(at, n).nbytes > most_bytes:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def join_hot(rows: DataFrame, partners: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with partners, which hold each key once at most, however many rows share a key.

    Rows with a hot key meet their partner by broadcast: there are fewer than 1 / HOT_SHARE such keys, whatever the
    table. The others meet by a sorted join, in which no key then has more than HOT_SHARE of the rows. Hashes of the hot keys say which way a row goes, so a key
    that shares one goes the same way as its partner. rows is read three
    times, so it should be a staged table. Null keys match nothing.
    """
    least = rows.count() * HOT_SHARE
    way = F.xxhash64(*keys)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > least) & (F.col("n") > 1)).select(way.alias("way")).collect()
    if not hot:
        return rows.join(partners.hint("merge"), keys, how)
    is_hot = way.isin([r.way for r in hot])
    here = rows.where(is_hot).join(F.broadcast(partners.where(is_hot)), keys, how)
    return here.unionByName(rows.where(~is_hot).join(partners.where(~is_hot).hint("merge"), keys, how))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long) as rows (node, root), root being the smallest node.

    Alternating large-star and small-star steps: every step hangs nodes on the smallest neighbour they
    know, so the number of rows never grows beyond the edges and a long chain halves in each round. Each
    round is written out, so that a lost executor costs one round at most. Edges that are stars already take no round.
    """
    def distinct_pairs(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def least_neighbour(pairs):
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    def stars(pairs):
        """Whether no node that hangs on another has nodes of its own, and none hangs on two."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(pairs.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()

    now = staged(distinct_pairs(edges), "links")
    while not stars(now):
        # large star: every larger neighbour of a node hangs on the node's least neighbour (or itself)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = least_neighbour(both).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = distinct_pairs(large)
        # small star: the smaller neighbours of a node, and the node, hang on the least of them
        low = least_neighbour(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(distinct_pairs(small.union(low.select("a", F.col("m").alias("b")))), "links")
        unstage(now)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
