"""Observations that arrive in batches, folded into a table of one row for each key."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haggle.operators.upsert import fold, refold
from haggle.sources.storage import Versions, shared_folder


class Ingest:
    """Folds a stream by key. Version n of the table holds batches 0..n; a batch that is tried again writes its version again.

    A batch reads and writes only the buckets of its own keys. Another Ingest on the same path goes on where this one ended.
    """

    def __init__(self, spark: SparkSession, rows: T.StructType, key: str, seq: list[str], policy: dict[str, str], path: str | None = None, buckets: int = 1):
        self.spark, self.key, self.seq, self.policy = spark, key, seq, policy
        self.path = path or f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
        empty = fold(spark.createDataFrame([], rows), key, seq, policy)
        self.table = Versions(spark, f"{self.path}/table", empty.schema, key, buckets)

    @property
    def latest(self) -> int:
        return self.table.latest()

    def batch(self, rows: DataFrame, number: int) -> None:
        new = fold(rows, self.key, self.seq, self.policy).persist()
        touched = self.table.touched(new, number - 1)
        if touched:
            self.table.write(number, refold(self.table.read(number - 1, touched), new, self.key, self.policy))
        new.unpersist()
        self.table.tidy()

    def start(self, stream: DataFrame, **trigger):
        """A running query: trigger availableNow=True for one run, processingTime='60 seconds' for an endless one, which stop() ends."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/offsets").trigger(**trigger).start()

    def current(self) -> DataFrame:
        return self.table.read()


def first_requests(stream: DataFrame, keys: list[str], time_col: str, within: str) -> DataFrame:
    """The stream without requests whose keys have come before: each comes once, in the batch that brings it first.

    A request is forgotten once the stream's time is `within` past its own, so the state holds the requests of that time only; rows that come later than that go.
    """
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)


def all_succeeded(runs: DataFrame, code_col: str, *by: str) -> DataFrame:
    """Whether all runs (of each group) ended with code 0; a run without a code has not."""
    return runs.groupBy(*by).agg(F.bool_and(F.coalesce(F.col(code_col) == 0, F.lit(False))).alias("all_succeeded"))


def backoff(fails: int, base: float = 15, most: float = 600, chance: Callable[[], float] = random.random) -> float:
    """Seconds to wait after so many failures: doubled each time up to six times, within most, give or take a fifth."""
    return min(most, base * 2 ** min(fails, 6)) * (0.8 + 0.4 * chance())


def jitter(most: float = 10, chance: Callable[[], float] = random.random) -> float:
    """Seconds to wait before a first run, so that runs of many sites do not begin together."""
    return most * chance()


def with_retries(run: Callable[[], None], tries: int = 5, wait: Callable[[float], None] = time.sleep, **how) -> int:
    """Runs until it succeeds; the number of failures before. The last failure is raised."""
    for fails in range(tries):
        try:
            run()
            return fails
        except Exception:
            if fails + 1 == tries:
                raise
            wait(backoff(fails + 1, **how))
    return 0
