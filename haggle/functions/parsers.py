"""Prices, fees, currencies and times as they are written in posts, as column expressions.

Whatever cannot be read is null; callers put such rows aside with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Korean letters, the currency sign, and the word for "free".
HANGUL = "ㄱ-ㅎ가-힣"
FREE, WON_SIGN = "무료", "원"
WON, USD = "WON", "USD"


def _number(run: Column) -> Column:
    """The longest well-formed number at the end of a run of digits and commas, without commas; empty if there is none."""
    return F.replace(F.regexp_extract(run, r"(?:^|,)(\d{1,3}(?:,\d{3})+|\d+)$", 1), F.lit(","), F.lit(""))


def price_of_subject(subject: Column) -> Column:
    """The last amount that a slash or the end follows, else the last that the currency sign follows, else 0; null if too large for an int.

    A subject is cut at its slashes. Each part but the last offers the number after which it has no more digits or words than a
    unit; the last part offers one only if nothing but a unit comes after.
    """
    parts = F.split(subject, "/")
    run, unit = "([0-9,]*[0-9])", f"[{HANGUL}]*"
    offered = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.regexp_extract(x, f"{run}{unit}[^0-9{HANGUL}]*$", 1)).otherwise(F.regexp_extract(x, f"{run}{unit}$", 1)))
    signed = F.regexp_extract_all(subject, F.lit(f"{run}{WON_SIGN}"), F.lit(1))
    last = F.coalesce(*(F.try_element_at(F.filter(F.transform(c, _number), lambda n: n != ""), F.lit(-1)) for c in (offered, signed)))
    return F.when(subject.isNotNull(), F.when(last.isNull(), F.lit(0)).otherwise(last.try_cast("int")))


def currency_of_price(text: Column) -> Column:
    return F.when(text.contains("$"), USD).when(text.isNotNull(), WON)


def price_of_text(text: Column) -> Column:
    """A price field: dollars lose their sign and cents, won their commas and sign. Dollars with commas are not read."""
    bare = F.when(text.contains("$"), F.replace(text, F.lit("$"), F.lit(""))).otherwise(F.regexp_replace(text, rf"[,{WON_SIGN}]", ""))
    return bare.try_cast("double").try_cast("int")


def delivery_exact(text: Column) -> Column:
    """A delivery fee where just the word for free means 0."""
    return F.when(text == FREE, F.lit(0)).otherwise(F.regexp_replace(text, rf"[,{WON_SIGN}$]", "").try_cast("int"))


def delivery_loose(text: Column) -> Column:
    """A delivery fee: 0 if the word for free occurs, else the first run of digits, else 0."""
    run = F.regexp_extract(text, r"\d+", 0)
    return F.when(text.contains(FREE) | (run == ""), F.lit(0)).otherwise(run.try_cast("int"))


def shop_of_subject(subject: Column) -> Column:
    """What stands in brackets at the start."""
    return F.nullif(F.regexp_extract(subject, r"^\[(.*?)\]", 1), F.lit(""))


def time_of(text: Column, pattern: str, zone: str = "Asia/Seoul") -> Column:
    """The UTC instant of a local time, as a timestamp without a zone. The session's own zone plays no part."""
    read = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} xx"))
    none = F.lit(0)
    local = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, (F.unix_micros(read) / 1_000_000).cast("decimal(18,6)"))
    return local if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
