"""From stored pages of a site to typed deals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.functions import html, parsers, text
from haggle.operators import vectors
from haggle.plans.sites import Site


def page_urls(bases: DataFrame, base_col: str, pages: int) -> DataFrame:
    """bases with the URLs of their list pages 1..pages: page, url (the base and the number)."""
    return bases.select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page")).withColumn("url", F.concat(base_col, F.col("page").cast("string")))


def list_urls(spark: SparkSession, site: Site, pages: int | None = None) -> DataFrame:
    """The URLs of a site's list pages 1..n: page, url."""
    return page_urls(spark.createDataFrame([(site.base_url,)], "base string"), "base", pages or site.pages).select("page", "url")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order (which should have no ties; nulls come last), whatever partitions they come from."""
    others = [c for c in rows.columns if c not in keys]
    place = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), place).alias("row")).select(*keys, "row.*")


def rows_per_page(list_pages: DataFrame, selector: str) -> DataFrame:
    """How many rows each list page (url, html) has: url, n_rows."""
    return html.matches(list_pages.select("url", "html"), "html", selector, "n_rows")


def fragments(site: Site, list_pages: DataFrame) -> DataFrame:
    """The rows of list pages (url, html), one for each post: raw texts, article_id and the post's own URL.

    Each row is read for itself; a row without an id says nothing and goes. Of a post on several pages the first row by page
    and place counts.
    """
    found = html.rows(list_pages.select(F.col("url").alias("list_url"), "html"), "html", site.list_rows, site.list_fields)
    url = site.typed()["origin_url"]
    found = found.withColumn("article_id", site.derived["article_id"]()).withColumn("detail_url", url).where("article_id is not null")
    return first_seen(found, ["detail_url"], ["list_url", "place"]).drop("place")


def with_details(rows: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Rows of lists joined with the fields of their own pages. Posts without a page go."""
    return rows.join(details, key)


def items(site: Site, list_pages: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Raw items: fragments joined with the fields of their own pages (url, html). Posts without a page go."""
    details = html.fields(detail_pages.select(F.col("url").alias("detail_url"), "html"), "html", site.detail_fields)
    joined = with_details(fragments(site, list_pages), details, "detail_url")
    return joined.withColumn("time_text", site.derived["time_text"]()) if "time_text" in site.derived else joined


def typed(site: Site, raw: DataFrame, batch_time: str) -> DataFrame:
    """Raw items as columns of a deal, with `faults`: the columns that could not be read.

    A column that the site never sets keeps the table's default. A row with faults belongs in quarantine; it
    is never repaired or half stored.
    """
    made = site.typed()
    when = F.lit(batch_time).cast("timestamp_ntz")
    made |= {
        "article_id": F.concat(F.lit(site.prefix), F.col("article_id")), "community_name": F.lit(site.label), "write_at": parsers.time_of(text.strip(F.col("time_text")), site.time_format, site.zone),
        "crawled_at": when, "update_at": when,
    }
    for c in ("subject", "shop_name", "category", "thumbnail", "shop_url_1"):
        made.setdefault(c, F.col(c) if c in raw.columns else F.lit(None).cast("string"))
    must = [c for c in ("article_id", "price", "delivery_price", "recommend_count", "dislike_count", "view_count", "write_at") if c in made] + list(site.must)
    bad = F.array_compact(F.array(*(F.when(made[c].isNull(), F.lit(c)) for c in must)))
    return raw.select(*(made[c].alias(c) for c in made), bad.alias("faults"))


def split_faults(deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows for quarantine with the reasons."""
    return deals.where(F.size("faults") == 0).drop("faults"), deals.where(F.size("faults") > 0)


def stored(deals: DataFrame) -> DataFrame:
    """Deals as they are stored: the vector of the subject is set on every write, whatever a row brings for it."""
    return deals.withColumn("subject_trgm_vector", vectors.dense(F.col("subject")))
