"""Tables of the engine as DDL schemas, and the ways in which their columns have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEALS = (
    "id long, article_id string, community_name string, origin_url string, shop_url_1 string, shop_url_2 string, shop_name string, thumbnail string, subject string, "
    "subject_trgm_vector array<float>, category string, price int, currency string, delivery_price int, recommend_count int, dislike_count int, view_count int, "
    "create_at timestamp, write_at timestamp, update_at timestamp, crawled_at timestamp, is_end boolean"
)
POSTS = "id long, post_type string, title string, content string, author_id long, view_count int, created_at timestamp, created_id long, updated_at timestamp, updated_id long, is_hidden boolean, is_delete boolean"
COMMENTS = "id long, post_id long, parent_id long, author_id long, content string, created_at timestamp, created_id long, updated_at timestamp, updated_id long"
USERS = (
    "id long, provider string, social_id string, access_token string, access_token_expire_date timestamp, refresh_token string, refresh_token_expire_date timestamp, extra_data string, "
    "created_at timestamp, updated_at timestamp, kakao_id string, user_id string, email string, is_active boolean, is_authenticated boolean"
)
FAVORITES = "id long, deal_id long, user_id long, create_at timestamp, update_at timestamp"

#: Longest values of text columns; longer ones are rejected, never cut.
MAX_LENGTHS = {"community_name": 64, "origin_url": 512, "shop_url_1": 512, "shop_url_2": 512, "shop_name": 64, "thumbnail": 512, "subject": 512, "category": 32, "currency": 32}
POST_TYPES = ("NOTICE", "NORMAL")
#: Codes of post types before they were renamed; old rows keep them.
OLD_POST_TYPES = {"announce": "NOTICE", "normal": "NORMAL"}

#: What the API shows of a deal, in this order. It has neither the id nor the vector, and nothing of it can be written.
API_COLUMNS = [c for c in (x.split()[0] for x in DEALS.split(", ")) if c not in ("id", "subject_trgm_vector")]
#: What the admin list shows and may export, in this order.
ADMIN_COLUMNS = (
    "community_name category subject write_at create_at recommend_count view_count origin_url shop_url_1 article_id "
    "shop_name thumbnail price currency delivery_price dislike_count update_at crawled_at is_end"
).split()

#: What each admin list shows, in this order: posts and comments all that they have, the tables of single sites from before there was one for all these.
ADMIN_LISTS = {
    "deal": ADMIN_COLUMNS, "post": [x.split()[0] for x in POSTS.split(", ")], "comment": [x.split()[0] for x in COMMENTS.split(", ")],
    "coolnjoy": ["cool_n_joy_id", "category", "subject", "create_at", "recommend_count"], "ppomppu": ["article_id", "category", "subject", "create_at", "recommend_count"],
}


def shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """rows in the shape of a table: its columns in their order and types, null where rows have none. A value that the type cannot hold is an error; other columns go."""
    fields = T.StructType.fromDDL(ddl)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def evolve(old: DataFrame, new: DataFrame, casts: dict[str, str] | None = None, defaults: dict[str, object] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Old rows in the shape of new ones, beside them: columns retyped, added with a default or null, and dropped."""
    old = old.drop(*(drop or [])).withColumns({c: F.col(c).try_cast(t) for c, t in (casts or {}).items()})
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def renamed_codes(code: Column, names: dict[str, str] = OLD_POST_TYPES) -> Column:
    """Old enum codes by their new names; others as they are."""
    out = code
    for old, new in names.items():
        out = F.when(code == old, new).otherwise(out)
    return out


def faults(limits: dict[str, int] = MAX_LENGTHS, enums: dict[str, tuple] | None = None) -> Column:
    """Why a row is rejected: columns that are too long or hold an unknown code, as an array of texts."""
    checks = [F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")) for c, n in limits.items()]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*codes), F.lit(f"{c} has an unknown code")) for c, codes in (enums or {}).items()]
    return F.array_compact(F.array(*checks))
