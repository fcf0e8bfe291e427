"""The fold over a stream with the table in the state store: a batch works on the keys that it touches and on nothing else."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from haggle.operators.upsert import FIRST
from haggle.sources.storage import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _beyond(a: list, b: list) -> bool:
    """Whether a comes after b, nulls first."""
    return [(x is not None, x) for x in a] > [(x is not None, x) for x in b] if None in a or None in b else a > b


class _Fold(StatefulProcessor):
    """Holds of each key the values at both ends of what was seen, and the order of the ends."""

    def __init__(self, key: str, seq: list[str], policy: dict[str, str], state: T.StructType):
        self.key, self.seq, self.policy, self.schema = key, seq, policy, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("row", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.value.get() if self.value.exists() else None
        now = dict(zip(self.schema.names, now, strict=True)) if now is not None else None
        for row in rows:
            new = row.asDict()
            if now is None:
                now = {c: new[c] for c in self.schema.names}
                continue
            for side in ("first", "last"):
                own, other = ([x[f"{side}_{c}"] for c in self.seq] for x in (new, now))
                if _beyond(other, own) if side == FIRST else _beyond(own, other):
                    now |= {c: new[c] for c, rule in self.policy.items() if rule == side} | {f"{side}_{c}": new[f"{side}_{c}"] for c in self.seq}
        self.value.update(tuple(now[c] for c in self.schema.names))
        yield Row(**{self.key: key[0]}, **now)

    def close(self) -> None:
        pass


class StateFold:
    """Folds a stream by key as operators.upsert.fold does, in the RocksDB state store.

    The rows of a batch are folded in each input partition before they are dealt by key, so a key that holds most of a batch gives a row a partition. The state is
    written as changes of the touched keys; a query that starts again on the same path goes on where the last one ended. The session must use
    RocksDB for its state (use_rocksdb), and a path keeps its number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, rows: T.StructType, key: str, seq: list[str], policy: dict[str, str], path: str | None = None):
        self.spark, self.key, self.seq, self.policy = spark, key, seq, policy
        self.path = path or f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
        ends = [T.StructField(f"{side}_{c}", rows[c].dataType) for side in ("first", "last") for c in seq]
        self.state = T.StructType([*(T.StructField(c, rows[c].dataType) for c in policy), *ends])
        self.out = T.StructType([rows[key], *self.state.fields])

    def _partial(self, stream: DataFrame) -> DataFrame:
        """The fold of each Arrow batch: a row for each key in it, with the order of both its ends. Rows without a key go."""
        key, seq, policy, names = self.key, self.seq, self.policy, self.out.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in dict.fromkeys([key, *seq])], null_placement="at_start"))
                codes = rows.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
                cuts = np.flatnonzero(np.diff(codes)) + 1
                ends = {"first": rows.take(np.r_[0, cuts][: len(codes)]), "last": rows.take(np.r_[cuts, len(codes)][: len(codes)] - 1)}
                columns = {key: ends["first"].column(key)} | {c: ends[rule].column(c) for c, rule in policy.items()} | {f"{side}_{c}": x.column(c) for side, x in ends.items() for c in seq}
                yield from pa.table([columns[c] for c in names], names=names).combine_chunks().to_batches()

        return stream.select(*dict.fromkeys([key, *seq, *policy])).where(F.col(key).isNotNull()).mapInArrow(run, self.out)

    def changes(self, stream: DataFrame) -> DataFrame:
        """The stream of the rows of touched keys, as they are after a batch."""
        return self._partial(stream).groupBy(self.key).transformWithState(_Fold(self.key, self.seq, self.policy, self.state), self.out, "update", "none")

    def start(self, stream: DataFrame, **trigger):
        """A running query; stop() ends it, and so does trigger availableNow=True once all is read."""
        return self.changes(stream).writeStream.outputMode("update").format("noop").option("checkpointLocation", self.path).trigger(**trigger).start()

    def current(self) -> DataFrame:
        """The table as of the last batch, read from the state store."""
        state = self.spark.read.format("statestore").option("stateVarName", "row").load(self.path)
        return state.select(F.col(f"key.{self.key}").alias(self.key), "value.*")


class use_rocksdb:
    """Within it, streaming queries of the session keep their state in RocksDB, of which only changes are written."""

    def __init__(self, spark: SparkSession):
        self.conf, self.sets = spark.conf, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

    def __enter__(self):
        self.before = {k: self.conf.get(k, None) for k in self.sets}
        for k, v in self.sets.items():
            self.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.conf.set(k, v) if v is not None else self.conf.unset(k)
