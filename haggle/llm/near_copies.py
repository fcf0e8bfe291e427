"""Near copies by SimHash and word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash: the fingerprints of operation 1, and their classes by links of three bits or fewer
(simhash.near_links, with Golay-code keys). A class is a bucket; an exact check of the shingles with its least member follows.

Many texts of similarity 0.8 differ in more than three bits. Those meet in buckets by MinHash bands: BANDS keys a text,
each made of ROWS minima. What SimHash has connected is not compared again there. Two texts of similarity s have no
key in common with probability (1 - s^ROWS)^BANDS, 3 in a million at 0.8 and less above; that is the only loss, and
it strikes only texts that are not in one class, or in one too large for a task. Every link is decided by the shingles
themselves, and no group is written out as pairs:

* first each member of a bucket is compared with the bucket's least member, so a bucket of copies costs one
  comparison a member; that of a SimHash class needs no search for components, as a text is in one class;
* buckets of both kinds whose members are not all connected by that go each to one task, which compares those outside the largest
  component with all and returns links that connect the rest;
* buckets too large for a task are dealt anew by two bands, and again begin with the least member. What is too
  large even then is cut into parts, and each task compares two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, slices, staged
from .simhash import near_links, prints, shingle_hashes

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
_MIX = np.random.default_rng(11).integers(1 << 62, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.random.default_rng(12).integers(1 << 62, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1024
#: Members and shingles that a task compares at once.
LONGEST, MOST_SHINGLES = 4096, 1 << 21


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingle hashes; a text without a word has one of its own, so such texts are equal."""
    found = np.unique(shingle_hashes(text, WORDS))
    return found if len(found) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        mixed = (hashes[at : at + _CHUNK, None] ^ _MIX[0]) * _MIX[1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX[0]
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(29)) ^ np.arange(BANDS, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes reach SIMILAR."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILAR * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both) - 1e-9


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        keys = [band_keys(shingles(t)).view(np.int64) for t in part.column("body").to_pylist()]
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([part.column("node"), part.column("doc_id"), lists], names=["node", "doc_id", "keys"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = [shingles(t) for t in part.column("body").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "doc_id", "text_sha256")), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "doc_id", "text_sha256", "hashes"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yes = [similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(part.column("x"), part.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that are similar, by their shingles in sets(node, hashes)."""
    one, other = (sets.select(F.col("node").alias(n), F.col("hashes").alias(t)).hint("merge") for n, t in (("a", "x"), ("b", "y")))
    return staged(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(_decide, "a long, b long"), "similar")


def connecting_links(labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among texts with these component labels, as places, that connect just what all links among them connect.

    A text outside the largest component is compared with all others, through the lists of texts that hold its shingles.
    A link has an end outside the largest component when it is due, or connects nothing new.
    """
    size = np.array([len(x) for x in sets])
    begin = np.cumsum(size) - size
    flat = np.concatenate(sets)
    _, shingle, times = np.unique(flat, return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(shingle, kind="stable")]
    first = np.cumsum(times) - times
    _, label = np.unique(labels, return_inverse=True)
    largest = np.bincount(label).argmax()
    links = []
    for i in range(len(sets)):
        if label[i] == largest:
            continue
        own = shingle[begin[i] : begin[i] + size[i]]
        n = times[own]
        both = np.bincount(holder[np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)], minlength=len(sets))
        near = np.flatnonzero((both >= SIMILAR * (size + size[i] - both) - 1e-9) & (label != label[i]))
        if len(near):
            met, place = np.unique(label[near], return_index=True)
            links += [(i, int(j)) for j in near[place]]
            met = np.append(met, label[i])
            label[np.isin(label, met)] = largest if largest in met else met[0]
    return links


def _connect(bucket: pa.Table) -> pa.Table:
    node, hashes = bucket.column("node").to_numpy(), bucket.column("hashes").combine_chunks()
    links = connecting_links(bucket.column("root").to_numpy(), [x.values.to_numpy() for x in hashes])
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]})


def _in_tasks(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Connecting links of buckets (key, node, root) that fit a task each."""
    return staged(buckets.select("key", "node", "root").join(sets.select("node", "hashes").hint("merge"), "node").groupBy("key").applyInArrow(_connect, "a long, b long"), "similar")


def _members(entries: DataFrame) -> DataFrame:
    """entries (key, node, ...) whose key has two nodes or more, with centre, the least of these."""
    buckets = entries.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("key", "centre")
    return staged(join_hot(entries, staged(buckets, "buckets"), ["key"]).distinct(), "members")


def _by_print(rows: DataFrame) -> DataFrame:
    """Entries (key, node) of rows (node, body) by SimHash: the key is the class of the fingerprint, its least member."""
    own = prints(rows, "node", "body").withColumnRenamed("doc_id", "node")
    classes = components(near_links(own.select("fp").distinct())).withColumnRenamed("node", "fp")
    return staged(join_hot(own, classes, ["fp"], "left").select(F.coalesce("root", "fp").alias("key"), "node"), "entries")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that components roots (node, root) do not connect."""
    one, other = (roots.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("a", "r"), ("b", "s")))
    rooted = staged(pairs.join(one.hint("merge"), "a", "left"), "rooted")
    return join_hot(rooted, other, ["b"], "left").where("coalesce(r, a) <> coalesce(s, b)").select("a", "b")


def _to_centre(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of each node with the centres of its buckets."""
    return members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def _links(members: DataFrame, signed: DataFrame, sets: DataFrame, longest: int, most: int, finer: bool = True) -> DataFrame:
    """Links (a, b) that connect just those nodes of members (key, node, centre, by_print) which chains of links within keys connect."""
    links = _similar_pairs(_to_centre(members.where("by_print")), sets)
    # a class gives a star, so these links are components already
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    links = links.unionByName(_similar_pairs(_apart(_to_centre(members.where("not by_print")), stars), sets))
    roots = components(links)
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    placed = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = staged(placed.join(sets.select("node", F.size("hashes").alias("size")).hint("merge"), "node").select("key", "node", "root", "size"), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.greatest(F.ceil(F.count("*") / longest), F.ceil(F.sum("size") / most)).alias("parts")).where("r <> s").select("key", "parts")
    open_ = staged(open_, "open")
    if open_.isEmpty():
        return links
    left = staged(join_hot(placed, open_, ["key"]).select("key", "node", "root", "parts"), "left")
    links = links.unionByName(_in_tasks(left.where("parts = 1"), sets))
    large = left.where("parts > 1")
    if large.isEmpty():
        return links
    if finer:
        entries = large.join(signed.select("node", F.explode("keys").alias("k")).distinct().hint("merge"), "node").where("k <> key").select(F.xxhash64("key", "k").alias("key"), "node", F.lit(False).alias("by_print")).distinct()
        return links.unionByName(_links(_members(entries), signed, sets, longest, most, finer=False))
    # parts of half the size, two by two; each row is in one task for each part
    n = 2 * F.col("parts")
    own = F.pmod(F.xxhash64("node"), n)
    twos = large.withColumn("own", own).select("node", "root", "key", "own", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    return links.unionByName(_in_tasks(twos.select("node", "root", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")), sets))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """One row for each distinct (id, text) of docs that is similar to another or is there more than once:
    doc_id, text_sha256, component_id, kept, copies.

    Similar texts are linked; component_id is the smallest doc_id that links reach, null only if none there has an id. Of a
    component the text with the smallest id (ties: the smaller hash) has kept = true; copies says how many rows of docs have
    this id and text. A null text counts as empty; texts without a word are similar to each other; a text of fewer than
    five words is one shingle. Rows that share an id stay apart by their texts. Nodes are 64-bit hashes of id and text; if two
    clash, one of them is left without links. A task compares longest texts with most_shingles shingles together, about.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64(id_col, body).alias("node"), F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    signed = staged(rows.mapInArrow(_sign, "node long, doc_id long, keys array<long>"), "signed")
    copies = signed.groupBy("node").agg(F.count("*").alias("copies")).where("copies > 1")
    entries = _by_print(rows).select("key", "node", F.lit(True).alias("by_print")).union(signed.select(F.explode("keys"), "node", F.lit(False)))
    members = _members(entries)
    wanted = members.select("node").union(copies.select("node")).distinct()
    found = rows.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]).withColumn("text_sha256", F.sha2("body", 256))
    sets = staged(found.mapInArrow(_shingled, "node long, doc_id long, text_sha256 string, hashes array<long>"), "sets")
    roots = components(_links(members, signed, sets, longest, most_shingles))

    known = sets.drop("hashes").join(roots.hint("merge"), "node", "left").join(copies.hint("merge"), "node", "left").where("root is not null or copies is not null")
    known = known.withColumn("root", F.coalesce("root", "node")).withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    first = known.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "node"))["node"].alias("first"))
    return known.join(first.hint("merge"), "root").select("doc_id", "text_sha256", "component_id", (F.col("node") == F.col("first")).alias("kept"), "copies")
