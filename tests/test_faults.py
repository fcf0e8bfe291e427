"""Cases that once went wrong."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haggle.functions import html, parsers, text
from haggle.operators import collect, feed, upsert, vectors
from haggle.sources.storage import Versions
from haggle.streaming import ingest

POLICY = {"price": upsert.FIRST, "views": upsert.LAST}
SCHEMA = "key string, seq int, price int, views int"


def plain(df):
    return sorted((r.key, r.price, r.views) for r in df.collect())


def test_another_ingest_goes_on_and_writes_only_its_buckets(spark, tmp_path):
    one = spark.createDataFrame([("a", 1, 10, 1), ("b", 1, 20, 1)], SCHEMA)
    two = spark.createDataFrame([("b", 2, 99, 2)], SCHEMA)
    path = f"file://{tmp_path}/state"
    ingest.Ingest(spark, one.schema, "key", ["seq"], POLICY, path, buckets=64).batch(one, 0)
    again = ingest.Ingest(spark, one.schema, "key", ["seq"], POLICY, path)
    assert again.latest == 0 and plain(again.current()) == [("a", 10, 1), ("b", 20, 1)]
    again.batch(two, 1)
    again.batch(two, 1)  # tried again
    third = ingest.Ingest(spark, one.schema, "key", ["seq"], POLICY, path)
    assert third.latest == 1 and plain(third.current()) == [("a", 10, 1), ("b", 20, 2)]
    written = {f.name: [p.name for p in f.iterdir() if p.name.startswith("bucket=")] for f in (tmp_path / "state/table").iterdir() if f.name.startswith("v1-")}
    assert written and all(len(x) == 1 for x in written.values())
    third.batch(one.limit(0), 2)
    assert plain(third.current()) == [("a", 10, 1), ("b", 20, 2)]


def test_an_endless_run_can_be_stopped_and_goes_on(spark, tmp_path):
    def put(n, *rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(0, ("a", 1, 10, 1))
    for n, want in ((1, [("a", 10, 1)]), (2, [("a", 10, 5), ("b", 7, 7)])):
        job = ingest.Ingest(spark, spark.createDataFrame([], SCHEMA).schema, "key", ["seq"], POLICY, f"file://{tmp_path}/state")
        if n == 2:
            put(1, ("a", 2, 99, 5), ("b", 1, 7, 7))
        query = job.start(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), processingTime="1 seconds")
        query.processAllAvailable()
        query.stop()
        assert not query.isActive and plain(job.current()) == want


def test_a_version_that_is_not_whole_is_not_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "key string, x int")
    table = Versions(spark, f"file://{tmp_path}/t", df.schema, "key", 4)
    assert table.latest() == -1 and table.read().count() == 0
    table.write(0, df)
    table.write(1, df.withColumn("x", F.lit(2)))
    (tmp_path / "t/manifests/v000000000001.json").unlink()
    assert table.latest() == 0 and [r.x for r in table.read().collect()] == [1]
    for v in (1, 2, 3, 4):
        table.write(v, df.withColumn("x", F.lit(v)))
    table.tidy(2)
    assert [r.x for r in table.read().collect()] == [4] and [r.x for r in table.read(3).collect()] == [3]
    assert not list((tmp_path / "t/v0").glob("bucket=*"))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Seoul"])
def test_times_do_not_depend_on_the_session(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2025-03-09 02:30:00",), ("2025-11-02 01:30:00",), ("x",), (None,)], "t string")
        got = [str(r.x) for r in df.select(parsers.time_of(F.col("t"), "yyyy-MM-dd HH:mm:ss", "UTC").cast("string").alias("x")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2025-03-09 02:30:00", "2025-11-02 01:30:00", "None", "None"]


def test_deep_pages(spark):
    df = spark.createDataFrame([("<b>" * 5000 + "deep<p>x",)], "h string")
    row = html.fields(df, "h", {"p": "p text", "all": "b string"}).select("p", "all").first()
    assert row.p == "x" and row["all"] == "deepx"


def test_white_space_of_any_kind_goes(spark):
    df = spark.createDataFrame([("\n\t [x] a 　\r\n",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(text.strip(F.col("t")).alias("x")).collect()] == ["[x] a", "", None]


def test_the_first_of_clashing_rows_counts(spark):
    rows = [("u", p, k, f"{p}{k}") for p in (3, 1, 2) for k in (2, 0, 1)] * 2
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "url string, page int, place int, v string").repartition(parts)
        assert [r.v for r in collect.first_seen(df, ["url"], ["page", "place"]).collect()] == ["10"]


def test_new_rows_of_one_key_go_in_once(spark):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (3, None)], "k int, v string")
    assert sorted(map(str, upsert.insert_missing(table, rows, "k").collect())) == sorted(["Row(k=1, v='a')", "Row(k=2, v='b')", "Row(k=3, v=None)"])


def test_updates(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    out = upsert.update(table, spark.createDataFrame([(2, None), (9, "x")], "k int, v string"), "k", t=7)
    assert sorted(map(tuple, out.collect())) == [(1, "a", 0), (2, None, 7)]


def test_rows_without_a_time_come_last_on_pages_and_cursors_are_opaque(spark):
    rows = [(i, None if i % 4 == 0 else datetime(2024, 1, 1 + i % 3)) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(2024, 1, 1)).timestamp(), -r[0]))
    seen, cursor = [], None
    while True:
        page = feed.page(df, "t", "id", cursor).collect()
        seen += [(r.id, r.t) for r in page]
        if not page[-1].has_more:
            break
        cursor = feed.cursor_text(page[-1].t, page[-1].id)
    assert seen == want
    for at in (65, 50, 40):
        back = feed.page(df, "t", "id", feed.cursor_text(*seen[at][::-1]), backward=True).collect()
        assert [(r.id, r.t) for r in back][::-1] == seen[at - 30 : at]
    with pytest.raises(ValueError):
        feed.page(df, "t", "id", "no cursor")


def test_hidden_rows_stay_unless_asked(spark):
    df = spark.createDataFrame([(1, True, None), (2, None, False), (3, False, True)], "id int, is_hidden boolean, is_delete boolean")
    assert [r.id for r in feed.shown(df, "is_hidden", "is_delete").collect()] == [2] and feed.shown(df).count() == 3


def test_the_vector_is_set_on_write(spark):
    df = spark.createDataFrame([(1, "red bolt", [1.0]), (2, None, [2.0]), (3, "", None)], "id int, subject string, subject_trgm_vector array<float>")
    got = {r.id: r.subject_trgm_vector for r in collect.stored(df).collect()}
    assert len(got[1]) == 1024 and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and got[2] is None and set(got[3]) == {0.0}


def test_similar_titles_against_all_pairs(spark):
    names = ["red bolt", "red bolts", "green bolt", "blue nut", "red", "the the the", "", None, "bolt red"] * 3
    rows = list(enumerate(names))
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    vec = {r.id: {} for r in df.collect()}
    for r in vectors.buckets(df, "id", "t").collect():
        vec[r.id][r.bucket] = r.weight
    for block in (2048, 2):
        got = sorted(map(tuple, vectors.similar_titles(df, df.where("id % 3 = 0"), "id", "t", 4, block).collect()))
        want = []
        for q in range(0, len(rows), 3):
            found = sorted((-round(sum(w * vec[i].get(b, 0) for b, w in vec[q].items()), 6), i) for i in vec if i != q and set(vec[i]) & set(vec[q]))[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_cookies_keep_known_fields(spark):
    df = spark.createDataFrame([({"name": "a", "value": "b", "junk": "c", "expires": "12.7"},), ({"value": "x"},)], "c map<string,string>")
    assert [r.x for r in df.select(text.normal_cookie(F.col("c")).alias("x")).collect()] == [{"name": "a", "value": "b", "expiry": "12"}, {"value": "x"}]


def test_jitter():
    assert ingest.jitter(10, lambda: 0.5) == 5 and 0 <= ingest.jitter() <= 10


@pytest.mark.parametrize("subject, price", [("12,34원/x", 34), ("a 1234,567/", 567), ("1,234,567원 / 2,500원", 2500), ("a/b/c", 0), ("x 5개/무료/ 3", 3), ("3,000원원 무료배송", 3000)])
def test_more_prices(spark, subject, price):
    df = spark.createDataFrame([(subject,)], "s string")
    assert df.select(parsers.price_of_subject(F.col("s")).alias("p")).first().p == price
