"""What differs between the sites that posts come from, as data: where fields stand, how they read, how they are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from haggle.functions import parsers as P
from haggle.functions.text import strip

FIRST, LAST = "first", "last"


@dataclass(frozen=True)
class Site:
    """prefix and label mark a site's keys and rows; list_rows and detail are selectors and rules of its pages.

    policy says of each column whether the first or the last observation counts. Columns without a policy
    are never set. typed makes the columns of a deal from raw texts.
    """

    name: str
    prefix: str
    label: str
    pages: int
    base_url: str
    list_rows: str
    list_fields: dict[str, str]
    detail_fields: dict[str, str]
    time_format: str
    typed: Callable[[], dict[str, Column]]
    policy: dict[str, str]
    zone: str = "Asia/Seoul"
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)
    #: Columns without which a row is at fault, besides those that every site must have if it sets them.
    must: tuple[str, ...] = ()


def _policy(first: str, last: str) -> dict[str, str]:
    return {c: FIRST for c in first.split()} | {c: LAST for c in last.split()}


def _count(c: str) -> Column:
    return F.col(c).try_cast("int")


_DETAILS = "shop_url_1 shop_name thumbnail subject category crawled_at write_at price"

# Prefixes of keys, labels, selectors and time formats of the sites' pages.
SITES = {
    s.name: s
    for s in (
        Site(
            "arca", "arca", "ARCA", 5, "https://arca.live/b/hotdeal?p=", "div.list-table.hybrid .vrow.hybrid",
            {
                "href": "a.title.hybrid-title @href", "subject": "a.title.hybrid-title text:1", "category": ".col-title a.badge text", "shop_name": ".col-title .deal-store text",
                "thumbnail": ".vrow-preview img @src", "price_text": "span.deal-price text", "delivery_text": "span.deal-delivery text",
            },
            {
                "recommend_text": "div.article-info span ~1 text", "dislike_text": "div.article-info span ~4 text", "view_text": "div.article-info span ~10 text",
                "time_text": "div.article-info span ~11 > time text", "shop_url_1": "tbody tr a text",
            },
            "yyyy-MM-dd HH:mm:ss",
            lambda: {
                "price": P.price_of_text(F.col("price_text")), "currency": P.currency_of_price(F.col("price_text")), "delivery_price": P.delivery_exact(F.col("delivery_text")),
                "recommend_count": _count("recommend_text"), "dislike_count": _count("dislike_text"), "view_count": _count("view_text"),
                "origin_url": F.concat(F.lit("https://arca.live"), F.col("href")), "thumbnail": F.concat(F.lit("https:"), F.coalesce("thumbnail", F.lit("None"))),
            },
            _policy(f"{_DETAILS} currency community_name delivery_price", "origin_url recommend_count view_count dislike_count update_at"),
            zone="UTC",
            derived={"article_id": lambda: F.nullif(F.regexp_extract("href", r"^/b/hotdeal/(.*?)\?p=\d", 1), F.lit(""))},
        ),
        Site(
            "coolnjoy", "coolnjoy", "coolnjoy", 5, "https://coolenjoy.net/bbs/jirum?page=", "li.d-md-table-row",
            {"href": "a.na-subject @href", "subject": "a.na-subject string", "category": "#abcd text", "price_text": "font text", "recommend_text": ".rank-icon_vote text"},
            {"shop_url_1": ".pl-3 a text", "thumbnail": "div.view-content.fr-view img @href", "time_text": "time.f-xs text", "view_text": "li.pr-3:has(i.fa-eye) string"},
            "yyyy.MM.dd HH:mm",
            lambda: {
                "price": P.price_of_text(strip(F.col("price_text"))), "currency": P.currency_of_price(F.col("price_text")), "shop_name": P.shop_of_subject(strip(F.col("subject"))),
                "recommend_count": _count("recommend_text"), "view_count": F.regexp_replace("view_text", "[^0-9]", "").try_cast("int"), "origin_url": strip(F.col("href")),
                "subject": strip(F.col("subject")), "category": strip(F.col("category")),
            },
            _policy(f"{_DETAILS} origin_url currency community_name", "recommend_count view_count update_at"),
            derived={"article_id": lambda: F.nullif(F.regexp_extract("href", r"jirum/(.*?)\?", 1), F.lit(""))}, must=("shop_name",),
        ),
        Site(
            "eomisae", "eomisae", "EOMISAE", 5, "https://eomisae.co.kr/index.php?mid=fs&page=", "div.card_el",
            {"href": "a.pjax.hx @href", "subject": "h3 a.pjax text", "thumbnail": "img.tmb @src"},
            {
                "category": "span[title=Category] text", "recommend_text": "div.btm_area span ~2 > b text", "view_text": "div.btm_area span ~1 > b text",
                "time_text": "div.btm_area span ~5 text", "shop_url_1": "td.extra_url a @href",
            },
            "yyyy-MM-dd HH:mm:ss",
            lambda: {
                "price": F.lit(0), "currency": F.lit(P.WON), "delivery_price": F.lit(0), "recommend_count": _count("recommend_text"), "dislike_count": F.lit(0), "view_count": _count("view_text"),
                "origin_url": F.col("href"), "subject": F.btrim(F.regexp_replace("subject", "[\n\t\r]", ""), F.lit(" \t\n\r\f")),
            },
            _policy(f"{_DETAILS} currency community_name delivery_price", "origin_url recommend_count view_count dislike_count update_at"),
            derived={"article_id": lambda: F.nullif(F.regexp_extract("href", r"document_srl=(\d*)$", 1), F.lit(""))},
        ),
        Site(
            "fmkorea", "fm", "FMKOREA", 10, "https://www.fmkorea.com/hotdeal?page=", "div.fm_best_widget li",
            {"href": "h3.title a @href", "subject": "h3.title @data-original-title", "category": "span.category a text", "thumbnail": "img.thumb @data-original"},
            {
                "shop_url_1": "tr ~0 > div.xe_content a text", "shop_name": "tr ~1 > div.xe_content text", "delivery_text": "tr ~4 > div.xe_content text", "view_text": "div.side.fr b ~0 text",
                "recommend_text": "div.side.fr b ~1 text", "comment_text": "div.side.fr b ~2 text", "time_text": "span.date.m_no text",
            },
            "yyyy.MM.dd HH:mm",
            lambda: {
                "price": P.price_of_subject(F.col("subject")), "delivery_price": P.delivery_loose(F.col("delivery_text")), "recommend_count": _count("recommend_text"), "dislike_count": F.lit(0),
                "view_count": _count("view_text"), "origin_url": F.concat(F.lit("https://www.fmkorea.com/"), F.substr(F.col("href"), F.lit(2))),
                "subject": F.regexp_replace(F.regexp_replace("subject", "<[^>]*>", ""), "[\n\t\r]", ""),
            },
            _policy("", f"{_DETAILS} origin_url community_name delivery_price recommend_count view_count dislike_count update_at"),
            derived={"article_id": lambda: F.nullif(F.substr(F.col("href"), F.lit(2)), F.lit(""))},
        ),
        Site(
            "ppomppu", "ppompu", "PPOMPPU", 5, "https://www.ppomppu.co.kr/zboard/zboard.php?id=ppomppu&page=", "tr.bbs_new1",
            {
                "article_id": "td ~0 string", "href": "td ~1 > a @href", "thumbnail": "td ~1 > a.baseList-thumb img @src", "category": "td ~1 > small text",
                "shop_name": "td ~1 > a.baseList-title span em text", "subject": "td ~1 > a.baseList-title span text", "view_text": "td ~5 string",
            },
            {"shop_url_1": "li.topTitle-link a text", "recommend_text": "span#vote_list_btn_txt text", "dislike_text": "span#vote_anti_list_btn_txt text", "time_text": "ul.topTitle-mainbox li text"},
            "yyyy-MM-dd HH:mm",
            lambda: {
                "price": P.price_of_subject(F.col("subject")), "delivery_price": F.lit(0), "recommend_count": _count("recommend_text"), "dislike_count": _count("dislike_text"), "view_count": _count("view_text"),
                "origin_url": F.concat(F.lit("https://www.ppomppu.co.kr/zboard/"), F.col("href")), "subject": F.regexp_replace("subject", "<[^>]*>", ""),
                "category": F.expr("substring(category, 2, length(category) - 2)"), "shop_name": F.expr("substring(shop_name, 2, length(shop_name) - 2)"),
            },
            _policy(f"{_DETAILS} origin_url community_name", "delivery_price recommend_count view_count dislike_count update_at"),
            derived={"article_id": lambda: F.nullif(F.col("article_id"), F.lit("")), "time_text": lambda: F.substr(F.col("time_text"), F.lit(5))},
        ),
    )
}
