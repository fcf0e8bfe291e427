import hashlib
import random

import pytest
from pyspark.sql import functions as F

from haggle.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        top = max(ids, key=lambda x: (x is not None, x or 0))
        out.append((str(i), str(top), len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def rows(long=5000):
    rng = random.Random(1)
    pool = ["", None, "a", "A", "a ", "é", "é", "ab" * 7, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "0123456789" * 13] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    out = [(i, rng.choice(pool)) for i in range(300)]
    return out + [(None, "a"), (None, None), (7, "a"), (7, "a"), (7, "other"), (900, "long " * long), (901, "long " * long), (902, "long " * long + "x")]


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.octet_length(b).cast("long") % 3, lambda b: F.lit(5).cast("long")])
def test_against_brute_force_even_if_all_keys_clash(spark, route):
    data = rows(300)
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in data], "doc_id long, text string, name string, width int").repartition(5)
    out = exact_dedup(df, block_bytes=8, route=route).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == brute(data)
    assert sum(r.kept for r in out) == len({t or "" for _, t in data})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_block_size_does_not_matter(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    results = [sorted(map(str, exact_dedup(df, block_bytes=b).drop("kept").collect())) for b in (1000, 4096)]
    assert results[0] == results[1]
    assert exact_dedup(df.limit(0)).count() == 0
