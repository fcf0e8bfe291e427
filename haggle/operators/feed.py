"""The feed of deals: pages by keyset, facets, filters and lookups."""

from __future__ import annotations

import base64
import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 30


def cursor_text(time: datetime | None, key: object) -> str:
    """An opaque cursor after the row with this time and id."""
    return base64.urlsafe_b64encode(json.dumps([time and time.isoformat(), key]).encode()).decode()


def cursor_of(text: str) -> tuple:
    """The (time, id) of an opaque cursor. A text that is none is an error."""
    time, key = json.loads(base64.urlsafe_b64decode(text))
    return time and datetime.fromisoformat(time), key


def page(rows: DataFrame, time_col: str, id_col: str, cursor: tuple | str | None = None, size: int = PAGE, backward: bool = False) -> DataFrame:
    """A page of rows, newest first (ties: larger id first; rows without a time come last), after the cursor (time, id), or before it if backward.

    One row more than a page is read, so the page knows whether another follows: column has_more. The k best rows of
    each task are enough; nothing is sorted as a whole. The cursor becomes a range on the time column, which
    reaches the scan.
    """
    order = [F.asc_nulls_first(time_col), F.asc(id_col)] if backward else [F.desc_nulls_last(time_col), F.desc(id_col)]
    if cursor is not None:
        time, last = cursor_of(cursor) if isinstance(cursor, str) else cursor
        t, i, at = F.col(time_col), F.col(id_col), F.lit(time)
        if time is None:
            rows = rows.where(t.isNotNull() | (i > last) if backward else t.isNull() & (i < last))
        elif backward:
            rows = rows.where((t >= at) & ((t > at) | (i > last)))
        else:
            rows = rows.where(t.isNull() | (t <= at) & ((t < at) | (i < last)))
    found = rows.orderBy(*order).limit(size + 1)
    return found.withColumn("has_more", F.count("*").over(_all()) > size).orderBy(*order).limit(size)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over one page at most


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """The values of each column and how often each occurs: facet, value, n. All columns are counted in one scan, a null as a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def counted(rows: DataFrame, condition: Column) -> DataFrame:
    """How many rows there are, and how many meet a condition: total, filtered."""
    return rows.agg(F.count("*").alias("total"), F.count(F.when(condition, 1)).alias("filtered"))


def shown(rows: DataFrame, *flags: str) -> DataFrame:
    """Rows of which no flag (is_hidden, is_delete) is set; a null flag is not set. Lists apply this only where asked to."""
    for f in flags:
        rows = rows.where(~F.coalesce(F.col(f), F.lit(False)))
    return rows


def equal(rows: DataFrame, **values) -> DataFrame:
    """Rows with the given values; a value of None is no condition."""
    for c, v in values.items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    return rows


def in_preset(time_col: str, preset: str, as_of: datetime) -> Column:
    """Whether a time is in a preset range of days around as_of: today, past 7 days, this month, this year."""
    day = datetime(as_of.year, as_of.month, as_of.day)
    tomorrow = day + timedelta(days=1)
    month_end = datetime(day.year + day.month // 12, day.month % 12 + 1, 1)
    start, end = {
        "today": (day, tomorrow), "past_7_days": (day - timedelta(days=7), tomorrow), "this_month": (datetime(day.year, day.month, 1), month_end), "this_year": (datetime(day.year, 1, 1), datetime(day.year + 1, 1, 1)),
    }[preset]
    return (F.col(time_col) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time_col) < F.lit(end).cast("timestamp_ntz"))


def only(rows: DataFrame, key: str, value) -> DataFrame:
    """The one row with this key. A missing key gives no row, a second row an error, both when the result is read."""
    found = rows.where(F.col(key) == F.lit(value)).limit(2)
    n = F.count("*").over(_all())
    return found.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than one row with this {key}")).cast("boolean"))).drop("_n")


def numbered_page(rows: DataFrame, key: str, number: int, size: int = 100) -> DataFrame:
    """Page `number` (from 1) of rows by descending key."""
    return rows.orderBy(F.desc(key)).offset((number - 1) * size).limit(size)
