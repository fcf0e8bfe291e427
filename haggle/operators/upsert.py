"""Repeated observations of a key folded into one row, by a rule for each column.

There is no lookup and no merge: the first (or last) value of every column is an aggregate, so a batch is one
hash aggregation with partial results before the shuffle, and folding a fold gives the same as folding everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST, LAST = "first", "last"


def fold(rows: DataFrame, key: str, seq: list[str], policy: dict[str, str]) -> DataFrame:
    """One row for each key: of each column the value of its first or last observation in order of seq.

    seq must order the observations of a key without ties. A null value counts like any other: the last one
    replaces what was there. Besides, first_* and last_* keep the order of both ends, so that
    the result can be folded again with later rows (see refold).
    """
    order = F.struct(*seq)
    return rows.groupBy(key).agg(*(_end(F.col(c), order, rule).alias(c) for c, rule in policy.items()), *_ends(rows, seq))


def _end(value: Column, order: Column, rule: str) -> Column:
    return F.min_by(value, order) if rule == FIRST else F.max_by(value, order)


def _ends(rows: DataFrame, seq: list[str]) -> list[Column]:
    order = F.struct(*seq)
    return [F.min(order).alias("first_seen"), F.max(order).alias("last_seen")]


def refold(state: DataFrame, batch: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Two folds over disjoint observations as one fold over both, whichever was seen earlier."""
    both = state.unionByName(batch)
    kept = [(F.min_by(c, "first_seen") if rule == FIRST else F.max_by(c, "last_seen")).alias(c) for c, rule in policy.items()]
    return both.groupBy(key).agg(*kept, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def insert_stamped(table: DataFrame, rows: DataFrame, **server_set: object) -> DataFrame:
    """table and new rows, whose server-set columns (author, parent, times) are the same for all and win over what rows bring."""
    return table.unionByName(rows.withColumns({c: F.lit(v) for c, v in server_set.items()}), allowMissingColumns=True)


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those rows whose key it does not hold; of new rows with one key the least by their other columns."""
    others = [c for c in table.columns if c != key]
    new = rows.join(table.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*others)).alias("row")).select(key, "row.*")
    return table.unionByName(new)


def update(table: DataFrame, changes: DataFrame, key: str, **server_set: object) -> DataFrame:
    """table with the columns of changes (one row a key) in their place where the key is there; server-set columns change with them.

    A column that changes lack stays, and a null in changes replaces what was there. Keys that the table lacks say nothing.
    """
    new = [c for c in changes.columns if c != key]
    told = changes.select(F.col(key).alias("_key"), F.struct(*new).alias("_new"))
    both = table.join(told, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    sets = {c: F.col(f"_new.{c}") for c in new} | {c: F.lit(v) for c, v in server_set.items()}
    return both.select(*(F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in table.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign_key: str) -> tuple[DataFrame, DataFrame]:
    """parents and children without the gone keys and what refers to them."""
    ids = gone.select(F.col(key).alias("_gone"))
    return parents.join(ids, F.col(key) == F.col("_gone"), "left_anti"), children.join(ids, F.col(foreign_key) == F.col("_gone"), "left_anti")


def write(table: DataFrame, key: str, created: DataFrame | None = None, changed: DataFrame | None = None, gone: DataFrame | None = None, **server_set: object) -> DataFrame:
    """table after the writes of an API, in this order: rows created (with keys that it lacks, else they say nothing), changed (see update), and gone by key.

    server_set are columns that the server sets on rows that are created or changed, whatever these bring. With sources.storage.Versions.update the writes of several at once come one after another.
    """
    if created is not None:
        new = created.withColumns({c: F.lit(v) for c, v in server_set.items()})
        table = insert_missing(table, new.select(*(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema)), key)
    if changed is not None:
        table = update(table, changed, key, **server_set)
    if gone is not None:
        ids = gone.select(F.col(key).alias("_gone")).distinct()
        table = table.join(ids, F.col(key) == F.col("_gone"), "left_anti")
    return table
