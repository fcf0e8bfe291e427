"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are cut into blocks. Block i of a source of weight w is released at slot floor(i / w) and due
at slot ceil((i + 1) / w); each slot takes, of the released blocks, the one that is due first. After any number of
slots every source is then less than one block away from its share. The weights are taken as the exact fractions that the
given numbers are; nothing is rounded, so the bound holds for the targets themselves and at every length. When a
source runs out, the weights of the others are scaled up and a new phase begins, whose slots count from zero.

The driver lays out the slots of all blocks; blocks are made larger where there would be more than MAX_BLOCKS. Rows
find their slot by a join with that bounded table.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Blocks that the driver lays out at most, some seconds of its time and 16 MB; with more rows, blocks are larger.
MAX_BLOCKS = 1 << 20
#: Sources at most; each is a phase at worst.
MAX_SOURCES = 4096


def one_phase(parts: list[int], blocks: list[int]) -> list[int]:
    """Which source each slot takes, up to the slot with the last block of some source.

    parts: the weights as whole numbers of any size; of released blocks the one with the earliest deadline goes first
    (ties: the first source).
    """
    whole = sum(parts)
    waiting = [(0, s, 0) for s in range(len(parts))]  # by release
    ready: list[tuple[int, int, int]] = []  # by deadline
    slots: list[int] = []
    while True:
        while waiting and waiting[0][0] <= len(slots):
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * whole // parts[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots.append(s)
        if i + 1 == blocks[s]:
            return slots
        heapq.heappush(waiting, ((i + 1) * whole // parts[s], s, i + 1))


def schedule(blocks: list[int], weights: list[float]) -> np.ndarray:
    """The source of every slot, until all blocks of all sources have one."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact)) if exact else 1
    parts = [int(w * scale) for w in exact]
    left, out = list(blocks), [np.zeros(0, np.int32)]
    while active := [s for s in range(len(left)) if left[s]]:
        order = np.array(active, np.int32)[one_phase([parts[s] for s in active], [left[s] for s in active])]
        for s, n in zip(*np.unique(order, return_counts=True), strict=True):
            left[s] -= int(n)
        out.append(order)
    return np.concatenate(out)


def _numbers(order: np.ndarray) -> np.ndarray:
    """Of each slot the number of its block within its source."""
    by_source = np.argsort(order, kind="stable")
    first = np.r_[True, order[by_source][1:] != order[by_source][:-1]] if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[by_source] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", carry: list[str] | None = None, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row for each row of docs: doc_id, source, block, place (in the block), slot; with carry also those columns as a struct `row`.

    The mixture is the rows in order of slot, then place. Rows of a source keep the order of their ids. weights gives
    each source's target share (any scale); without it a source counts as the square root of its rows. A
    source that weights does not name comes after all others, in the same way and by its size. A null source is a
    source; null ids come first in it; repeated rows all stay. Nothing is dropped or repeated. Blocks have block_rows rows,
    or more where that would give over max_blocks of them. More than MAX_SOURCES sources are an error. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *([F.struct(*carry).alias("row")] if carry else []))
    order = [F.col("source"), F.col("doc_id")]
    # ranged by source and id, so that a large source spreads over many partitions
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "mix")
    # one row for each source in each partition: partitions and sources together at most, as both are in order
    stretches = numbered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("seq").alias("start"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start"))
    counts = stretches.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = [weights is None or r.source in weights for r in counts]
    share = [float(weights[r.source]) if weights and ok else r.n**0.5 for r, ok in zip(counts, named, strict=True)]
    if any(not 0 < w < float("inf") for w in share):
        raise ValueError("weights must be positive")
    total = sum(r.n for r in counts)
    size = max(block_rows, -(-total // max(1, max_blocks - len(counts))))
    blocks = [-(-r.n // size) for r in counts]
    taken = np.concatenate([schedule([b if ok == first else 0 for b, ok in zip(blocks, named, strict=True)], share) for first in (True, False)])
    keys = taken.astype(np.int64) << 32 | _numbers(taken)
    slots = spark.createDataFrame(pa.table({"at": keys, "slot": np.arange(len(keys), dtype=np.int64)}))
    kind = docs.schema[source_col].dataType.simpleString()
    sources = spark.createDataFrame([(r.source, k) for k, r in enumerate(counts)], f"s {kind}, number long")
    where = stretches.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("part").alias("p"), "shift", "number")
    rank = F.col("seq") + F.col("shift")
    block = F.floor(rank / size)
    placed = numbered.join(F.broadcast(where), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        "doc_id", "source", block.alias("block"), (rank % size).cast("int").alias("place"), (F.shiftleft("number", 32) + block).alias("at"), *(["row"] if carry else [])
    )
    return placed.join(F.broadcast(slots), "at").select("doc_id", "source", "block", "place", "slot", *(["row"] if carry else []))
