"""Near-duplicate documents by SimHash fingerprints, found with Golay-code keys.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Two fingerprints that differ in 3 bits or
fewer spread these over the segments in one of two ways:

* some segment is equal. Then, going round the segments A -> B -> C -> A, there is an equal segment whose
  successor differs in 2 bits or fewer (were each equal segment followed by one with 3 differences, the
  others would be equal and one of them followed by an equal one). Key: the equal segment, and a
  codeword near its successor.
* each segment differs in exactly one bit. Then half of C is equal, A of the one decodes to a codeword
  near A of the other, and the same for B the other way round. Key: both codewords and the half of C.

Rows of equal key are joined in sorted runs and compared bit by bit. A run gives a spanning forest of its
links, not all its pairs. Members of a run longer than a task should hold meet again under finer keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import components, join_hot, slices, staged

MAX_BITS = 3
_CUTS = ((0, 21), (21, 21), (42, 22))


def shingle_hashes(text: bytes, words_in_shingle: int) -> np.ndarray:
    """The XXH64 hashes (seed 42) of all shingles of the text with A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_in_shingle, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    """SimHash over the hashes of all shingles of the text."""
    hashes = shingle_hashes(text, words_in_shingle)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [fingerprint(t, words_in_shingle) for t in part.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side): rows that differ in at most 3 bits have a key in common; 1 and 2 are to meet, 0 meets 0."""
    a, b, c = ((fps >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in _CUTS)
    segments = (a, b, c)
    rows, keys, sides = [], [], []
    nears = [golay.near(s) for s in segments]
    for kind, (equal, (row, index)) in enumerate(zip(segments, nears[1:] + nears[:1], strict=True)):
        rows.append(row)
        keys.append((kind << 60) | (equal[row] << 12) | index)
        sides.append(np.zeros(len(row), np.int8))
    for side, fuzzy, other in ((1, nears[0], golay.decode(b)), (2, nears[1], golay.decode(a))):
        row, index = fuzzy
        first, second = (index, other[row]) if side == 1 else (other[row], index)
        for half in (0, 1):
            rows.append(row)
            keys.append(((3 + half) << 60) | (first << 23) | (second << 11) | (c[row] >> (11 * half) & 0x7FF))
            sides.append(np.full(len(row), side, np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def block_keys(parts: int):
    """Keys by pigeonhole: of `parts` blocks of bits, all but three are equal."""
    width = 64 // parts

    def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, found = [], []
        for k, free in enumerate(combinations(range(parts), MAX_BITS)):
            mask = ~np.uint64(sum(((1 << width) - 1) << (width * f) for f in free))
            rows.append(np.arange(len(fps)))
            # the free bits carry the number of the combination, so that keys of different ones never meet
            label = sum((k >> (width * i) & ((1 << width) - 1)) << (width * f) for i, f in enumerate(free))
            found.append(((fps & mask) | np.uint64(label)).view(np.int64))
        return np.concatenate(rows), np.concatenate(found), np.zeros(len(fps) * len(found), np.int8)

    return keys


def _keyed(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps = batch.column("fp").to_numpy()[at : at + 2048]
                row, key, side = keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side.astype(np.int32)), pa.array(fps[row])], names=["key", "side", "fp"])

    return run


def spanning_links(fps: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints (uint64), as (larger, smaller) places."""
    label = np.arange(len(fps))
    links = []
    for i in range(1, len(fps)):
        close = np.bitwise_count(fps[:i] ^ fps[i]) <= MAX_BITS
        if sides is not None:
            close &= sides[:i] != sides[i]
        near = np.flatnonzero(close)
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            links += [(i, j) for j in near[first].tolist()]
            if len(met) > 1:
                label[np.isin(label[:i], met).nonzero()[0]] = met[0]
            label[i] = met[0]
    return links


def _runs(longest: int | None):
    """mapInArrow function over rows sorted by key: links (a, b) of each run; members of longer runs as (a, null)."""

    def solve(fps: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ordered = np.unique(fps) if not sides.any() else None
        if ordered is not None:
            u, s = ordered.view(np.uint64), None
        else:
            if len(np.unique(sides)) < 2:
                return fps[:0], fps[:0]
            u, s = fps.view(np.uint64), sides
        links = spanning_links(u, s)
        at = np.array(links, np.int64).reshape(-1, 2)
        return u[at[:, 0]].view(np.int64), u[at[:, 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b=None):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["a", "b"])

        kept: list[np.ndarray] = []  # of the run that goes on: fps and sides
        now, size, over = None, 0, False

        def close():
            if size > 1 and not over:
                fps, sides = np.concatenate(kept[0::2]), np.concatenate(kept[1::2])
                a, b = solve(fps, sides)
                if len(a):
                    yield out(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, side = (batch.column(c).to_numpy() for c in ("key", "fp", "side"))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            wanted = np.flatnonzero(ends - starts > 1)
            las, lbs = [], []
            for r in np.unique(np.r_[0, wanted, len(starts) - 1]).tolist():
                a, b = int(starts[r]), int(ends[r])
                if key[a] != now:
                    yield from close()
                    now, size, over, kept = key[a], 0, False, []
                inside = a > 0 and b < len(key)
                if inside and (longest is None or b - a <= longest):
                    if b - a == 2:
                        if bin(int(fp[a] ^ fp[a + 1]) & 0xFFFFFFFFFFFFFFFF).count("1") <= MAX_BITS and fp[a] != fp[a + 1] and (side[a] == 0 or side[a] != side[a + 1]):
                            las.append(fp[a : a + 1])
                            lbs.append(fp[a + 1 : b])
                    else:
                        x, y = solve(fp[a:b], side[a:b])
                        las.append(x)
                        lbs.append(y)
                    size = 0
                    continue
                size += b - a
                if over:
                    yield out(fp[a:b])
                else:
                    kept += [fp[a:b], side[a:b]]
                    if longest is not None and size > longest:
                        over = True
                        yield out(np.concatenate(kept[0::2]))
                        kept = []
            if las:
                yield out(np.concatenate(las), np.concatenate(lbs))
        yield from close()

    return run


#: Keys in the order in which they are tried. The last have 12 free bits, so that a run has 4096 members at most.
_LEVELS = (golay_keys, block_keys(8), block_keys(16))


def near_links(fps: DataFrame, longest: int = 4096) -> DataFrame:
    """Links (a, b) that connect just those distinct fingerprints fps(fp long) that chains of at most 3 bits connect."""
    links = None
    for k, keys in enumerate(_LEVELS):
        last = k == len(_LEVELS) - 1
        rows = fps.mapInArrow(_keyed(keys), "key long, side int, fp long")
        found = staged(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(None if last else longest), "a long, b long"), "near")
        these = found.where("b is not null")
        links = these if links is None else links.unionByName(these)
        fps = found.where("b is null").select(F.col("a").alias("fp")).distinct()
        if last or fps.isEmpty():
            return links


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """The fingerprint of each row as a staged table (doc_id, fp); a null text counts as empty."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).mapInArrow(_fingerprints(words_in_shingle), "doc_id long, fp long"), "prints")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, longest: int = 4096) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in 3 bits or fewer are linked; component_id is the smallest doc_id that links
    reach. A null, empty or blank text has fingerprint zero and is linked like any other. Rows that share
    a doc_id stay apart, each with its own fingerprint. A null doc_id gets a component_id too: null only if no row
    of the component has an id. An empty table gives an empty result. longest bounds how many
    fingerprints one task compares at once; longer runs are dealt anew by finer keys.
    """
    own = prints(docs, id_col, text_col, words_in_shingle)
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("fp"), longest)).withColumnRenamed("node", "fp")
    labelled = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(labelled.join(smallest, "root").select("fp", "component_id"), "classes")
    # exact copies and empty texts share a fingerprint, so one may have a third of all rows
    return join_hot(own, classes, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
