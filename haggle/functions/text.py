"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that mark a link as one to a known shop. Fixed values.
SHOPS = ("coupang", "naver", "musinsa", "11st", "gmarket", "ozip", "kakao", "lotteon")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def drop_escapes(c: Column) -> Column:
    """Without newlines, tabs and returns."""
    return F.regexp_replace(c, r"[\n\t\r]", "")


def strip_blanks(c: Column) -> Column:
    """Without HTML blanks at the ends."""
    return F.btrim(c, F.lit(" \t\n\r\f"))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def inner(c: Column, front: int = 1, back: int = 1) -> Column:
    """The text without `front` characters before and `back` after."""
    return F.substring(c, F.lit(front + 1), F.greatest(F.length(c) - front - back, F.lit(0)))


def captured(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def digits(c: Column) -> Column:
    """The number that is left when everything but digits goes; null if there is none or it is too large."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def is_shop(url: Column) -> Column:
    """Whether a link's host names a known shop; null for what is not a link."""
    lowered = F.lower(host(url))
    found = F.lit(False)
    for shop in SHOPS:
        found = found | lowered.contains(shop)
    return found


def cookies(header: Column) -> Column:
    """A Cookie header as a map."""
    return F.str_to_map(header, F.lit("; ?"), F.lit("="))


#: What is kept of a cookie. Fixed values.
COOKIE_FIELDS = ("name", "value", "domain", "path", "secure", "httpOnly", "sameSite")


def normal_cookie(fields: Column) -> Column:
    """A cookie (a map) with known fields only, and its end as `expiry`, whichever of its three names it stood under."""
    known = F.map_filter(fields, lambda k, v: k.isin(*COOKIE_FIELDS) & v.isNotNull())
    end = expiry(fields)
    return F.when(end.isNull(), known).otherwise(F.map_concat(known, F.create_map(F.lit("expiry"), end.cast("string"))))


def expiry(fields: Column) -> Column:
    """A cookie's end in epoch seconds, under whichever of its three names it stands."""
    return F.coalesce(*(F.try_element_at(fields, F.lit(k)).try_cast("double").try_cast("long") for k in ("expiry", "expires", "expirationDate")))


def with_scheme(proxy: Column) -> Column:
    """A proxy address with http:// before it if it has no scheme; null if blank."""
    bare = F.nullif(F.btrim(proxy), F.lit(""))
    return F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("http://"), bare))


def mentions(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, whatever its case."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower(c).contains(w.lower())
    return found


def anchor(url: Column) -> Column:
    """An HTML link to url that opens a new page."""
    safe = F.replace(F.replace(F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('<a href="'), safe, F.lit('" target="_blank" rel="noopener noreferrer">'), safe, F.lit("</a>"))


def label(column: str, verbose: dict[str, str] | None = None) -> str:
    """The heading of a column: its verbose name, or its own with blanks and a capital."""
    return (verbose or {}).get(column) or column.replace("_", " ").capitalize()
