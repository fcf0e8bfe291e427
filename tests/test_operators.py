import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haggle.operators import collect, export, feed, forum, upsert
from haggle.plans.sites import SITES
from haggle.sources import schemas
from haggle.streaming import ingest

POLICY = {"price": upsert.FIRST, "views": upsert.LAST}


def observations(spark, n=200):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(20)}", i, rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, seq int, price int, views int")


def plain(df):
    return sorted((r.key, r.price, r.views) for r in df.collect())


def test_fold_keeps_first_and_last_and_does_not_depend_on_batches(spark):
    rows, df = observations(spark)
    whole = upsert.fold(df, "key", ["seq"], POLICY)
    want = {}
    for k, _, price, views in rows:
        want[k] = (want[k][0] if k in want else price, views)
    assert plain(whole) == sorted((k, *v) for k, v in want.items())
    parts = [upsert.fold(df.where(f"seq % 3 = {i}"), "key", ["seq"], POLICY) for i in (2, 0, 1)]
    state = upsert.refold(upsert.refold(parts[0], parts[1], "key", POLICY), parts[2], "key", POLICY)
    assert plain(state) == plain(whole) and plain(upsert.refold(whole, whole, "key", POLICY)) == plain(whole)


def test_stream_gives_the_fold_and_repeats_a_batch_safely(spark, tmp_path):
    rows, df = observations(spark)
    for i in range(4):
        df.where(f"seq % 4 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = ingest.Ingest(spark, df.schema, "key", ["seq"], POLICY, f"file://{tmp_path}/state")
    job.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), availableNow=True).awaitTermination()
    assert job.latest >= 3 and plain(job.current()) == plain(upsert.fold(df, "key", ["seq"], POLICY))
    job.batch(df.limit(0), job.latest)
    assert job.current().count() <= 20


def test_backoff():
    assert ingest.backoff(1, chance=lambda: 0.5) == 30 and ingest.backoff(99, chance=lambda: 0.5) == 600 and ingest.backoff(0, chance=lambda: 0) == 12
    waits, left = [], [2]

    def run():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError

    assert ingest.with_retries(run, wait=waits.append) == 2 and len(waits) == 2
    with pytest.raises(ZeroDivisionError):
        ingest.with_retries(lambda: 1 / 0, tries=2, wait=waits.append)


def test_pages_together_are_the_feed(spark):
    rng = random.Random(2)
    rows = [(i, datetime(2024, 1, rng.randint(1, 5))) for i in range(95)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz")
    seen, cursor, sizes = [], None, []
    while True:
        page = feed.page(df, "t", "id", cursor).collect()
        seen += [(r.t, r.id) for r in page]
        sizes.append(len(page))
        if not page[-1].has_more:
            break
        cursor = (page[-1].t, page[-1].id)
    assert sizes == [30, 30, 30, 5] and seen == sorted(((t, i) for i, t in rows), reverse=True)
    back = feed.page(df, "t", "id", seen[60], backward=True).collect()
    assert sorted(((r.t, r.id) for r in back), reverse=True) == seen[30:60]
    assert feed.page(df.limit(0), "t", "id").collect() == []


def test_only_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    assert feed.only(df, "id", 1).first().v == "a" and feed.only(df, "id", 9).count() == 0
    with pytest.raises(Exception, match="more than one"):
        feed.only(df, "id", 2).collect()


def test_thread(spark):
    df = spark.createDataFrame([(1, 1, None, 1), (1, 2, 1, 2), (1, 3, 1, 3), (1, 4, 2, 4), (2, 9, None, 1), (3, 8, 77, 1)], "post_id int, id int, parent_id int, created_at int").withColumn("content", F.lit("x"))
    assert [r.id for r in forum.thread(df, post=1).collect()] == [1, 2, 3, 4]
    nested = {r.id: [x.id for x in r.replies or []] for r in forum.nested_replies(df).collect()}
    assert nested[1] == [3, 2] and nested[2] == [4] and nested[4] == []
    assert {r.id: r.path for r in forum.paths(df).collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 2, 4], 9: [9]}
    with pytest.raises(ValueError):
        forum.paths(df, most_rounds=1)


def test_a_chain_of_ten_thousand_in_fifteen_rounds(spark):
    chain = spark.range(1, 10_001).select(F.lit(1).alias("post_id"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    # a circle, what hangs on it, and what hangs on nothing
    others = spark.createDataFrame([(1, 20_001, 20_003), (1, 20_002, 20_001), (1, 20_003, 20_002), (1, 20_004, 20_003), (1, 30_001, 30_000), (1, 30_002, 30_001), (2, 1, None), (2, 2, 1)], "post_id int, id long, parent_id long")
    found = forum.paths(chain.unionByName(others), with_path=False, most_rounds=15)
    assert found.where("post_id = 1").agg(F.count("*"), F.sum("depth"), F.max("depth"), F.max("root_id")).first() == (10_000, 10_000 * 9_999 // 2, 9_999, 1)
    assert sorted(map(tuple, found.where("post_id = 2").select("id", "root_id", "depth").collect())) == [(1, 1, 0), (2, 1, 1)]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x")], "view_count int, price int, subject string")
    got = export.headed(export.chosen(df, ["subject", "view_count"], schemas.ADMIN_COLUMNS))
    assert (got.columns, tuple(got.first())) == (["Subject", "View count"], ("x", 1))
    assert export.as_json(df).first().json == '{"view_count":1,"price":null,"subject":"x"}'
    with pytest.raises(ValueError):
        export.chosen(df, ["secret"], schemas.ADMIN_COLUMNS)
    export.write_csv(df, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").columns == ["View count", "Price", "Subject"]
    assert len(schemas.API_COLUMNS) == 20 and len(schemas.ADMIN_COLUMNS) == 19
    assert spark.createDataFrame([], schemas.DEALS).columns[0] == "id"


SPANS = "".join(f"<span>{x}</span>" for x in ["추천", "12", "", "비추", "3", "", "", "", "", "", "987"]) + "<span><time>2025-01-02 03:04:05</time></span>"
PAGES = {
    "arca": (
        '<div class="list-table hybrid"><div class="vrow hybrid"><div class="col-title"><a class="badge">전자</a><span class="deal-store">쿠팡</span></div><a class="title hybrid-title" href="/b/hotdeal/456?p=2"><b>x</b>\n<i>y</i> SSD 1TB\n</a>'
        '<span class="deal-price">12,900원</span><span class="deal-delivery">무료</span><div class="vrow-preview"><img src="//i/1.png"></div></div></div>',
        f'<div class="article-info">{SPANS}</div><table><tbody><tr><td><a>https://shop</a></table>',
        "https://arca.live/b/hotdeal/456?p=2", dict(article_id="arca456", price=12900, currency="WON", delivery_price=0, view_count=987, thumbnail="https://i/1.png", shop_name="쿠팡", write_at=datetime(2025, 1, 2, 3, 4, 5)),
    ),
    "coolnjoy": (
        '<ul><li class="d-md-table-row"><a class="na-subject" href=" https://x/bbs/jirum/123?page=1 "> [Amazon] <b>SSD</b> </a><span id="abcd"> PC </span><font> $12.99 </font><i class="rank-icon_vote">7</i></li></ul>',
        '<div class="pl-3"><a> https://a </a></div><time class="f-xs">2025.01.02 03:04</time><ul><li class="pr-3"><i class="fa fa-eye"></i> 1,234 조회</li></ul>',
        "https://x/bbs/jirum/123?page=1", dict(article_id="coolnjoy123", price=12, currency="USD", shop_name="Amazon", view_count=1234, recommend_count=7, write_at=datetime(2025, 1, 1, 18, 4)),
    ),
    "eomisae": (
        '<div class="card_el"><a class="pjax hx" href="https://e/?mid=fs&amp;document_srl=789"></a><h3><a class="pjax">\n Shoes\t</a></h3><img class="tmb" src="t.png"></div>',
        '<span title=Category>패션</span><div class="btm_area"><span></span><span><b>50</b></span><span><b>4</b></span><span></span><span></span><span>2025-01-02 03:04:05</span></div><table><tr><td class="extra_url"><a href="https://s">s</a></table>',
        "https://e/?mid=fs&document_srl=789", dict(article_id="eomisae789", price=0, currency="WON", subject="Shoes", view_count=50, recommend_count=4, category="패션", shop_url_1="https://s", write_at=datetime(2025, 1, 1, 18, 4, 5)),
    ),
    "fmkorea": (
        '<div class="fm_best_widget"><ul><li><h3 class="title" data-original-title="[11번가] 키보드 35,000원/3,000원"><a href="/321">x</a></h3><img class="thumb" data-original="t"><span class="category"><a>PC</a></span></li></ul></div>',
        "<table>" + "".join(f'<tr><td><div class="xe_content">{x}</div></td></tr>' for x in ["<a>https://s</a>", "11번가", "키보드", "35,000", "3,000원"]) + '</table><div class="side fr"><b>100</b><b>5</b><b>2</b></div><span class="date m_no">2025.01.02 03:04</span>',
        "https://www.fmkorea.com/321", dict(article_id="fm321", price=3000, delivery_price=3, shop_name="11번가", shop_url_1="https://s", view_count=100, recommend_count=5, dislike_count=0),
    ),
    "ppomppu": (
        '<table><tr class="bbs_new1"><td>77</td><td><a href="view.php?no=77"></a><a class="baseList-thumb"><img src="i"></a><small>[디지털]</small><a class="baseList-title"><span><em>[쿠팡]</em>생수 (9,900원/무료)</span></a></td><td>a<td>b<td>c<td>55</td></tr><tr class="bbs_new1"><td></td></tr></table>',
        '<ul class="topTitle-mainbox"><li>등록일 2025-01-02 03:04</li></ul><li class="topTitle-link"><a>https://s</a></li><span id="vote_list_btn_txt">9</span><span id="vote_anti_list_btn_txt">1</span>',
        "https://www.ppomppu.co.kr/zboard/view.php?no=77", dict(article_id="ppompu77", price=9900, delivery_price=0, category="디지털", shop_name="쿠팡", view_count=55, recommend_count=9, dislike_count=1, write_at=datetime(2025, 1, 1, 18, 4)),
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_become_deals(spark, name):
    site, (listing, detail, url, want) = SITES[name], PAGES[name]
    lists = spark.createDataFrame([("l1", listing), ("l2", listing), ("l3", None)], "url string, html string")
    details = spark.createDataFrame([(url, detail), ("other", "<p>")], "url string, html string")
    good, bad = collect.split_faults(collect.typed(site, collect.items(site, lists, details), "2025-02-01 00:00:00"))
    row = good.collect()
    assert len(row) == 1 and bad.count() == 0
    assert {c: row[0][c] for c in want} == want and row[0].community_name == site.label
    assert set(site.policy) <= set(good.columns)
    broken = details.withColumn("html", F.lit("<p>nothing</p>"))
    good, bad = collect.split_faults(collect.typed(site, collect.items(site, lists, broken), "2025-02-01 00:00:00"))
    assert good.count() == 0 and "write_at" in bad.first().faults


def test_list_urls(spark):
    urls = [r.url for r in collect.list_urls(spark, SITES["fmkorea"]).orderBy("page").collect()]
    assert len(urls) == 10 and urls[0].endswith("page=1")


def test_whole_flow_keeps_first_and_last_values(spark):
    site, (listing, detail, url, _) = SITES["ppomppu"], PAGES["ppomppu"]
    batches = []
    for n, (a, b) in enumerate([("9,900", "55"), ("8,800", "99")]):
        lists = spark.createDataFrame([("l", listing.replace("9,900", a).replace(">55<", f">{b}<"))], "url string, html string")
        details = spark.createDataFrame([(url, detail)], "url string, html string")
        good, _ = collect.split_faults(collect.typed(site, collect.items(site, lists, details), f"2025-02-0{n + 1} 00:00:00"))
        batches.append(upsert.fold(good.withColumn("seq", F.lit(n)), "article_id", ["seq"], site.policy))
    row = upsert.refold(*batches, "article_id", site.policy).first()
    assert (row.price, row.view_count, str(row.crawled_at)[:10], str(row.update_at)[:10]) == (9900, 99, "2025-02-01", "2025-02-02")
