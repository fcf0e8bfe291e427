import numpy as np
from pyspark.sql import functions as F

from haggle.llm.vector_search import quantised, top_k


def brute(rows, k):
    ok = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, qv in asked.items():
        found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, k, **how):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert sorted(map(tuple, top_k(quantised(df), F.col("vec_id") % 50 == 0, k, **how).collect())) == brute(rows, k)
    return df


def test_against_all_pairs_with_ties_nulls_and_bad_values(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 5).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(9)]
    rows += [(2000, None), (2100, [float("nan")] * 5), (2150, [0.1, None, 0.1, 0.1, 0.1]), (2200, [float("inf")] + [0.0] * 4), (2250, [0.0] * 5)]
    for k, most in ((5, 1 << 20), (3, 16), (1000, 1 << 20)):
        df = check(spark, rows, k, query_components=most)
    assert top_k(quantised(df.limit(0)), F.lit(True)).count() == 0


def test_repeated_ids_and_other_lengths(spark):
    """Copies of an id are candidates each, wherever their bounds stand; lengths may differ, empty vectors too."""
    rng = np.random.default_rng(4)
    rows = [(900, [1.0, 1.0]), (900, [1.0, 1.0])] + [(901 + i, [0.9, 0.9 - i / 1000]) for i in range(9)] + [(50, [1.0, 0.5]), (50, [0.5, 1.0])]
    check(spark, rows, 5)
    rows += [(1000 + i, rng.normal(0, 0.5, rng.integers(0, 7)).tolist()) for i in range(120)] + [(2000, []), (None, [0.1]), (2050, [9.0])]
    rows += [(int(i), rng.normal(0, 0.5, 3).tolist()) for i in rng.integers(0, 60, 200)]
    for k in (1, 5, 40):
        check(spark, rows, k)


def test_a_large_group_of_equal_vectors(spark):
    rows = [(i, [0.25, -0.5, 0.75]) for i in range(3000)] + [(5000 + i, [0.1 * i, 0.0, 0.2]) for i in range(20)]
    check(spark, rows, 5)
