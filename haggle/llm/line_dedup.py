"""Lines that many documents share, dropped everywhere but in one document.

Hashes of line keys are range-partitioned together with the document, so that the occurrences of one very
common line spread over many partitions, and sorted by hash, then document (largest first), then position.
A stream over each partition finds first occurrences and emits the others. Only the first and the last
hash of a partition may go on in a neighbour; their totals, two rows a partition, are put together after.
The result is a bitmap of kept lines for each document that loses lines, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged

_LINES = "h1 long, h2 long, doc_id long, text_key long, n_lines int, first int, positions array<int>"
_FOUND = "kind int, h1 long, h2 long, doc_id long, text_key long, n_lines int, positions array<int>, n_docs long"
DROP, OPEN, TOTAL = 0, 1, 2


def line_rows(min_chars: int):
    """mapInArrow function: one row for each key of at least min_chars code points in each document."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = pc.split_pattern(pc.ascii_lower(batch.column("text")), "\n")
        offsets = lists.offsets.to_numpy()
        key = pc.ascii_trim_whitespace(lists.flatten())
        base, count = offsets[:-1] - offsets[0], np.diff(offsets)
        at = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), min_chars).to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(len(count)), count)[at]
        pos = at - base[doc]
        digests = b"".join(map(xxhash.xxh3_128_digest, key.take(pa.array(at)).cast(pa.binary()).to_pylist()))
        h = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
        order = np.lexsort((pos, h[:, 1], h[:, 0], doc))
        doc, pos, h = doc[order], pos[order].astype(np.int32), h[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        ends = pa.array(np.append(first, len(doc)).astype(np.int32))
        take = pa.array(doc[first])
        return pa.RecordBatch.from_arrays(
            [pa.array(h[first, 0]), pa.array(h[first, 1]), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(count[doc[first]].astype(np.int32)), pa.array(pos[first]), pa.ListArray.from_arrays(ends, pa.array(pos))],
            names=["h1", "h2", "doc_id", "text_key", "n_lines", "first", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield keys(part)

    return run


def first_occurrences(min_docs: int):
    """mapInArrow function over rows sorted by hash, document (descending), position.

    Emits a DROP row for each row of a hash that min_docs documents or more hold, but for those of its first
    document. The first run of a partition may have begun in the one before: its rows go out as OPEN.
    The last run may go on in the next: as long as it has fewer than min_docs documents, its rows go out as
    OPEN too. Each of these two runs gives a TOTAL row. The rows of fewer than min_docs documents are held back.
    """

    def rows(batch, kind, at) -> pa.RecordBatch:
        part = batch.take(pa.array(at))
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *(part.column(c) for c in ("h1", "h2", "doc_id", "text_key", "n_lines", "positions")), pa.nulls(n, pa.int64())],
            names=["kind", "h1", "h2", "doc_id", "text_key", "n_lines", "positions", "n_docs"],
        )

    def total(h, doc, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([TOTAL], pa.int32()), pa.array([h[0]], pa.int64()), pa.array([h[1]], pa.int64()), pa.array([doc], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([n], pa.int64())],
            names=["kind", "h1", "h2", "doc_id", "text_key", "n_lines", "positions", "n_docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = True  # the current run is the first of the partition
        now, top, last, n = None, None, None, 0  # its hash, first document, latest document and count of documents
        held: pa.RecordBatch | None = None  # its rows, while it is not the first run and has few documents
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(h1)]
            # runs of one row say nothing, unless they stand at the batch's ends
            wanted = np.flatnonzero(ends - starts > 1)
            wanted = np.unique(np.r_[0, wanted, len(starts) - 1])
            drops, opens = [], []
            for r in wanted.tolist():
                a, b = int(starts[r]), int(ends[r])
                h = (int(h1[a]), int(h2[a]))
                if h != now:
                    if now is not None and opening:
                        yield total(now, top, n)
                    opening = now is None
                    now, top, last, n, held = h, int(doc[a]), None, 0, None
                own = doc[a:b]
                fresh = np.r_[own[0] != last, own[1:] != own[:-1]]
                before, n, last = n, n + int(fresh.sum()), int(own[-1])
                if opening:
                    opens.append(np.arange(a, b))
                elif n >= min_docs:
                    if held is not None:
                        yield rows(held, DROP, np.flatnonzero(held.column("doc_id").to_numpy() != top))
                        held = None
                    drops.append(a + np.flatnonzero(own != top))
                elif b == len(h1):
                    part = batch.slice(a, b - a)
                    held = part if before == 0 else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            if drops:
                yield rows(batch, DROP, np.concatenate(drops))
            if opens:
                yield rows(batch, OPEN, np.concatenate(opens))
        if now is not None:
            yield total(now, top, n)
            if held is not None:
                yield rows(held, OPEN, np.arange(held.num_rows))

    return run


def keep_bitmap(positions, n_lines: int) -> bytes:
    """The deflated bitmap of n_lines bits, 0 at the given positions."""
    keep = np.ones(n_lines, bool)
    keep[np.asarray(positions, dtype=np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


@F.pandas_udf(T.BinaryType())
def _packed(positions: pd.Series, n_lines: pd.Series) -> pd.Series:
    return pd.Series([keep_bitmap(p, n) for p, n in zip(positions, n_lines, strict=True)])


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def kept_lines(bitmap: pd.Series, n_lines: pd.Series) -> pd.Series:
    """A keep bitmap as one boolean a line."""
    return pd.Series([None if b is None else np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=int(n)).astype(bool) for b, n in zip(bitmap, n_lines, strict=True)])


def text_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, text_key, n_lines, n_dropped, keep_bitmap.

    Lines end at \\n. A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of at
    least min_chars code points that min_docs documents or more hold loses all its lines except those in
    the largest doc_id that holds it, where all stay. Documents that lose nothing have no row. A null or
    empty text is one empty line. Rows that share a doc_id count as one document; text_key (the text's
    64-bit hash) tells their bitmaps apart. Rows with a null doc_id take no part. No other column is
    looked at. Keys are compared by 128-bit hashes.
    """
    # written out, as dealing by ranges reads its input twice
    lines = staged(text_of(docs, id_col, text_col).where("doc_id is not null").mapInArrow(line_rows(min_chars), _LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "first")
    found = staged(ordered.mapInArrow(first_occurrences(min_docs), _FOUND), "lines")
    totals = found.where(F.col("kind") == TOTAL).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs)
    # two rows a partition at most: small enough to broadcast, and the rows of a common line stay where they are
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(totals.drop("n")), ["h1", "h2"]).where("doc_id <> top").drop("top")
    drops = found.where(F.col("kind") == DROP).unionByName(late)
    by_doc = drops.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("n_lines").alias("n_lines"))
    return by_doc.select("doc_id", "text_key", "n_lines", F.size("positions").alias("n_dropped"), _packed("positions", "n_lines").alias("keep_bitmap"))


def kept_text(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as rows (doc_id, n_lines, n_dropped, kept_text), with the bitmaps of line_dedup applied."""
    # bitmaps grow with the corpus: a sorted join at every size, never a broadcast
    keep = bitmaps.select("doc_id", "text_key", "n_dropped", kept_lines("keep_bitmap", "n_lines").alias("keep")).hint("merge")
    lines = F.split("text", "\n")
    return text_of(docs, id_col, text_col).join(keep, ["doc_id", "text_key"], "left").select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce(F.col("n_dropped").cast("long"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: F.get("keep", i)), "\n")).alias("kept_text"),
    )
