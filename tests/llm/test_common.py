import random

from haggle.llm import common


def test_join_with_hot_keys_gives_the_rows_of_a_join(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.1 else rng.choice([1] * 900 + list(range(1500))), i) for i in range(4000)]
    partners = [(k, f"p{k}") for k in range(0, 1400)]
    left = spark.createDataFrame(rows, "k long, i int").repartition(5)
    right = spark.createDataFrame(partners, "k long, p string")
    names = dict(partners)
    for how in ("inner", "left"):
        got = sorted((r.i, str(r.p)) for r in common.join_hot(left, right, ["k"], how).collect())
        assert got == sorted((i, str(names.get(k))) for k, i in rows if how == "left" or k in names)
    assert common.join_hot(left.limit(0), right, ["k"]).count() == 0


def test_staged_tables_go(spark):
    since = common.mark()
    one, two = (common.staged(spark.range(n), "t") for n in (3, 4))
    common.unstage(one)
    three = common.staged(two, "t")
    common.clear(spark, since, keep=three)
    assert three.count() == 4 and common.mark() == since + 1
    common.clear(spark, since)
    assert common.mark() == since


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "staged", lambda df, label, f=common.staged: written.append(label) or f(df, label))
    stars = spark.createDataFrame([(3, 1), (1, 5), (4, 2), (4, 2), (6, 6)], "a long, b long")
    assert sorted(tuple(r) for r in common.components(stars).collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1)]
    assert len(written) == 1
    assert common.components(stars.limit(0)).collect() == [] and len(written) == 2
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 29), (30, 28)], "a long, b long")
    assert {r.node: r.root for r in common.components(chain).collect()} == {k: 0 for k in range(21)} | {28: 28, 29: 28, 30: 28}
