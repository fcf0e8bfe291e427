"""A table in sorted runs, for pages by time: a write adds a run and moves nothing, runs are merged later, and a page opens the files of its range only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haggle.operators.feed import PAGE, cursor_of, page
from haggle.sources.storage import Conflict, Manifests

#: Runs of one level that are merged into one of the next.
FAN = 8


def needed(files: list[list], time: str | None, size: int, backward: bool, first: bool) -> list[list]:
    """Of files [folder, name, level, low, high, rows], times from low to high as texts ('': none), those that may hold one of the next size rows from a time on.

    Going down, let some files lie wholly below the time, with size rows or more; then no row below the lowest of their times is among the next ones, nor is a file all of whose
    rows are lower needed. Going up it is the other way round.
    """
    if backward:
        ahead = [f for f in files if first or f[4] >= (time or "")]
        whole = sorted((f for f in ahead if first or f[3] > (time or "")), key=lambda f: f[4])
    else:
        ahead = [f for f in files if first or f[3] <= (time or "")]
        whole = sorted((f for f in ahead if first or f[4] < (time or "")), key=lambda f: f[3], reverse=True)
    n, end = 0, None
    for f in whole:
        n += f[5]
        end = f[4] if backward else f[3]
        if n >= size:
            return [f for f in ahead if (f[3] <= end if backward else f[4] >= end)]
    return ahead


class SortedRuns(Manifests):
    """Rows by time, newest first, then by id. The manifest names the files of every run with their least and greatest time and their number of rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time_col: str, id_col: str, file_rows: int = 1 << 20):
        super().__init__(spark, path)
        self.schema, self.time_col, self.id_col, self.file_rows = schema, time_col, id_col, file_rows

    def files(self, version: int | None = None) -> list[list]:
        return self._load(version) or []

    def _write(self, rows: DataFrame, level: int, n: int) -> list[list]:
        """Write a run of about n rows; its files."""
        folder, order = f"run-{uuid.uuid4().hex}", [F.desc_nulls_last(self.time_col), F.desc(self.id_col)]
        rows = rows.select(*self.schema.fieldNames())
        rows.repartitionByRange(max(1, -(-n // self.file_rows)), *order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{folder}")
        shown = F.coalesce(F.col(self.time_col).cast("string"), F.lit(""))
        told = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
        return [[folder, r.name, level, r.low, r.high, r.n] for r in told.agg(F.min(shown).alias("low"), F.max(shown).alias("high"), F.count("*").alias("n")).collect()]

    def _change(self, gone: set[str], new: list[list]) -> bool:
        """Take the runs that are gone out of the newest manifest and put new files in; False if another writer has merged them meanwhile."""
        while True:
            base = self.latest()
            files = self.files(base)
            if not gone <= {f[0] for f in files}:
                return False
            try:
                self._store(base + 1, [f for f in files if f[0] not in gone] + new)
                return True
            except Conflict:
                continue

    def add(self, rows: DataFrame) -> None:
        """Add a run. Rows are kept as they come: a row that is there already is there twice."""
        self._change(set(), self._write(rows, 0, rows.count()))

    def merge(self, fan: int = FAN) -> int:
        """Merge runs of the levels that have fan or more; how many were merged. May run beside writers and readers."""
        done = 0
        while True:
            files = self.files()
            levels: dict[int, set[str]] = {}
            for f in files:
                levels.setdefault(f[2], set()).add(f[0])
            full = next((level for level in sorted(levels) if len(levels[level]) >= fan), None)
            if full is None:
                return done
            old = [f for f in files if f[0] in levels[full]]
            new = self._write(self._read(old), full + 1, sum(f[5] for f in old))
            if self._change(levels[full], new):
                done += len(levels[full])
            elif new:
                self._remove(f"{self.path}/{new[0][0]}")

    def _read(self, files: list[list]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{folder}/{name}" for folder, name, *_ in files))

    def read(self) -> DataFrame:
        return self._read(self.files())

    def page(self, cursor: tuple | str | None = None, size: int = PAGE, backward: bool = False) -> DataFrame:
        """A page as operators.feed.page gives it, from the files that may hold a row of it."""
        time = cursor_of(cursor)[0] if isinstance(cursor, str) else cursor[0] if cursor else None
        text = None if time is None else self.spark.range(1).select(F.lit(time).cast(self.schema[self.time_col].dataType).cast("string")).first()[0]
        return page(self._read(needed(self.files(), text, size + 1, backward, cursor is None)), self.time_col, self.id_col, cursor, size, backward)

    def tidy(self, keep: int = 2) -> None:
        """Remove manifests but the newest `keep`, and runs that only they had."""
        known = self.versions()
        stays = {f[0] for v in known[-keep:] for f in self.files(v)}
        for v in known[:-keep]:
            for folder in {f[0] for f in self.files(v)} - stays:
                self._remove(f"{self.path}/{folder}")
            self._remove(f"{self.path}/manifests/v{v:012}.json")
