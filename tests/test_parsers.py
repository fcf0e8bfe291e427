import pytest
from pyspark.sql import functions as F

from haggle.functions import parsers as P
from haggle.functions import text as X
from haggle.operators import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "subject, price",
    [
        ("[쿠팡] 생수 2L 12개 (9,900원/무료)", 9900), ("[지마켓] 라면 40봉 21,900원 무료배송", 21900), ("[11번가] 키보드 35,000원/3,000원", 3000), ("USB 허브 $12.99/무료", 99), ("무료 나눔", 0), ("", 0),
        (None, None), ("99999999999원/무료", None), ("모니터 199,000", 199000),
    ],
)
def test_price_of_subject(spark, subject, price):
    assert one(spark, P.price_of_subject, subject) == price


@pytest.mark.parametrize("shown, price, currency", [("12,900원", 12900, "WON"), ("$12.99", 12, "USD"), ("$1,299", None, "USD"), ("무료", None, "WON"), (None, None, None)])
def test_price_of_text(spark, shown, price, currency):
    assert one(spark, P.price_of_text, shown) == price and one(spark, P.currency_of_price, shown) == currency


@pytest.mark.parametrize("shown, exact, loose", [("무료", 0, 0), ("무료배송", None, 0), ("3,000원", 3000, 3), ("2500원", 2500, 2500), ("", None, 0), (None, None, None)])
def test_delivery(spark, shown, exact, loose):
    assert one(spark, P.delivery_exact, shown) == exact and one(spark, P.delivery_loose, shown) == loose


def test_shop_and_times(spark):
    assert one(spark, P.shop_of_subject, "[Amazon] SSD") == "Amazon" and one(spark, P.shop_of_subject, "SSD") is None
    for shown, pattern, zone, want in (
        ("2025-01-02 03:04", "yyyy-MM-dd HH:mm", "Asia/Seoul", "2025-01-01 18:04:00"), ("2025.01.02 03:04", "yyyy.MM.dd HH:mm", "Asia/Seoul", "2025-01-01 18:04:00"),
        ("2025-01-02 03:04:05", "yyyy-MM-dd HH:mm:ss", "UTC", "2025-01-02 03:04:05"), ("soon", "yyyy.MM.dd HH:mm", "Asia/Seoul", "None"), (None, "yyyy.MM.dd HH:mm", "UTC", "None"),
    ):
        assert str(one(spark, lambda c, p=pattern, z=zone: P.time_of(c, p, z), shown)) == want


def test_text(spark):
    assert one(spark, lambda c: X.inner(c), "[x]") == "x" and one(spark, lambda c: X.inner(c), "[") == ""
    assert one(spark, lambda c: X.digits(c), "조회 1,234") == 1234 and one(spark, lambda c: X.digits(c), "none") is None
    assert one(spark, lambda c: X.is_shop(c), "https://m.coupang.com/x") is True and one(spark, lambda c: X.is_shop(c), "not a url") in (None, False)
    assert one(spark, lambda c: X.with_scheme(c), " 1.2.3.4:80 ") == "http://1.2.3.4:80" and one(spark, lambda c: X.with_scheme(c), " ") is None
    assert one(spark, lambda c: X.anchor(c), 'a"&<b>').count("&quot;&amp;&lt;b&gt;") == 2
    assert X.label("view_count") == "View count" and X.label("x", {"x": "Y"}) == "Y"


def test_trigram_vectors(spark):
    assert one(spark, lambda c: V.bucket(c), "abc") == 873
    assert sorted(one(spark, lambda c: V.trigrams(c), "Cat, cat!")) == ["  c", " ca", "at ", "cat"]
    dense = one(spark, lambda c: V.dense(c), "red bolt")
    assert len(dense) == 1024 and sum(x * x for x in dense) == pytest.approx(1)
    assert set(one(spark, lambda c: V.dense(c), " !")) == {0.0} and one(spark, lambda c: V.dense(c), None) is None
    df = spark.createDataFrame([(1, "red bolt"), (2, None), (3, "")], "id long, t string")
    sparse = {r.bucket: r.weight for r in V.buckets(df, "id", "t").collect()}
    assert {i + 1: x for i, x in enumerate(dense) if x} == pytest.approx(sparse)
