"""The graph index against the exact search."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from haggle.operators import ann, vectors
from haggle.operators.ann import Graph, TitleIndex, graphs, nearest, recall
from haggle.plans import catalogue
from haggle.sources.storage import Versions


def titles(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ar", "su", "vel", "dor", "pi", "ran", "ex", "ol", "qui", "ba", "nes"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(900)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(3, 8)))) for i in range(n)]


def test_recall_and_vectors_read(spark):
    rows = spark.createDataFrame(titles(2400), "id long, subject string").repartition(4)
    queries = rows.where("id % 20 = 0")
    index = graphs(rows, "id", "subject", part=1300).checkpoint()
    assert index.count() == 2 and index.select(F.sum(F.size("ids"))).first()[0] == 2400
    near = nearest(index, queries, "id", "subject", 5)
    got, found = near.collect(), recall(vectors.similar_titles(rows, queries, "id", "subject", 5), near).first().recall
    read = {r.query_id: r.n_read for r in got}
    print("recall", found, "mean read", np.mean(list(read.values())))
    assert len(read) == 120 and found >= 0.9 and np.mean(list(read.values())) < 2400 / 2
    assert all(r.query_id != r.id for r in got) and all(1 <= r.rank <= 5 for r in got)


def test_links_are_bounded_and_lead_everywhere():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 20)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = Graph.build(v, 1 + (rng.random(400) < 0.1), 8, 32)
    assert all(len(x) <= 16 for n in g.links for x in n[:1]) and all(len(x) <= 8 for n in g.links for x in n[1:])
    seen, waiting = {g.top}, [g.top]
    while waiting:
        for j in g.links[waiting.pop()][0]:
            if j not in seen:
                seen.add(j)
                waiting.append(j)
    assert len(seen) >= 398


def test_blocks_ties_and_empty_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "red ring"), (4, "blue bolt"), (5, None), (6, "!!"), (None, "red ring"), (4, "blue bolt")], "id long, subject string")
    for block in (2048, 1):
        monkeypatch.setattr(ann, "QUERY_BLOCK", block)
        got = [(r.query_id, r.rank, r.id) for r in nearest(graphs(rows, "id", "subject"), rows.dropDuplicates(["id"]), "id", "subject", 2).collect()]
        assert sorted(got) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
        exact = vectors.similar_titles(rows, rows.dropDuplicates(["id"]), "id", "subject", 2, block=block)
        assert sorted((r.query_id, r.rank, r.id) for r in exact.collect()) == sorted(got)
    assert graphs(rows.limit(0), "id", "subject").count() == 0
    assert nearest(graphs(rows, "id", "subject"), rows.limit(0), "id", "subject", 2).count() == 0
    assert vectors.similar_titles(rows.limit(0), rows, "id", "subject", 2).count() == 0


def test_index_beside_a_version(spark, tmp_path):
    rows = spark.createDataFrame(titles(300), "id long, subject string")
    table = Versions(spark, f"file://{tmp_path}/deals", rows.schema, "id", 4)
    table.write(0, rows.where("id < 200"))
    table.write(1, rows)
    index = TitleIndex(spark, table, "id", "subject")
    assert index.build(0) == 0 and index.build() == 1
    queries = rows.where("id % 20 = 0")
    old, new = (index.nearest(queries, 5, v) for v in (0, 1))
    assert max(r.id for r in old.collect()) < 200 <= max(r.id for r in new.collect())
    assert recall(vectors.similar_titles(rows, queries, "id", "subject", 5), new).first().recall >= 0.9


@pytest.mark.parametrize("k", [1, 7])
def test_exact_search_is_that_of_dense_products(spark, k):
    rows = spark.createDataFrame(titles(700, 3), "id long, subject string").repartition(3)
    queries = rows.where("id % 10 = 0")
    dense = {r.id: np.array(r.v) for r in rows.select("id", vectors.dense(F.col("subject")).alias("v")).collect()}
    ids = sorted(dense)
    m = np.array([dense[i] for i in ids], np.float64)
    got = {}
    for r in vectors.similar_titles(rows, queries, "id", "subject", k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))
    for q in ids[::10]:
        s = m @ dense[q]
        s[q] = -1
        best = np.sort(s)[::-1][:k]
        assert np.allclose([x for *_, x in sorted(got[q])], best, atol=2e-5)


def test_rows_of_one_text_are_one_node(spark, monkeypatch):
    names = titles(40, 5)
    rows = spark.createDataFrame([(i, names[i % 40][1]) for i in range(3000)] + [(7, names[7][1])], "id long, subject string").repartition(3)
    queries = rows.where("id % 50 = 0")
    one = None
    for together in (1 << 19, 700):
        monkeypatch.setattr(vectors, "_TOGETHER", together)
        index = graphs(rows, "id", "subject").checkpoint()
        deals = -(-3001 // together)
        assert index.select(F.sum(F.size("size")), F.sum(F.size("ids"))).first()[:] == (40 * deals, 3000)
        got = sorted((r.query_id, r.rank, r.id) for r in nearest(index, queries, "id", "subject", 3).collect())
        exact = sorted((r.query_id, r.rank, r.id) for r in vectors.similar_titles(rows, queries, "id", "subject", 3).collect())
        assert got == exact == (one or got) and len(got) == 180
        one = got
    assert all(r[2] == [i for i in range(r[0] % 40, 200, 40) if i != r[0]][r[1] - 1] for r in one)


def test_a_part_is_built_in_seconds():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4000, 1024)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    began = time.perf_counter()
    g = Graph.build(v, 1 + (rng.random(4000) < 0.06), 16, 64)
    took = time.perf_counter() - began
    assert took < 10 and len(g.links) == 4000  # some 24 s before, 2 s now
    best, score, read = g.search(v[:200], 16)
    assert (best[:, 0] == np.arange(200)).mean() > 0.9 and (read < 4000).all()


def test_products_of_common_and_rare_buckets():
    rng = np.random.default_rng(1)

    def some(n):
        size = rng.integers(1, 60, n)
        bucket = np.concatenate([np.sort(rng.choice(1024, k, replace=False, p=np.arange(1024, 0, -1) ** 4 / (np.arange(1024, 0.0, -1) ** 4).sum())) + 1 for k in size])
        return size, bucket, rng.random(len(bucket))

    def dense(size, bucket, weight):
        out = np.zeros((len(size), 1025))
        out[np.repeat(np.arange(len(size)), size), bucket] = weight
        return out

    asked, rows = some(200), some(3000)
    block = vectors._Asked(np.arange(200), *asked)
    assert 0 < block.dense.shape[1] < 1024 and len(block.of)
    assert np.allclose(block.products(*rows), dense(*asked) @ dense(*rows).T)
    cuts = list(block.cuts(*rows[:2]))
    assert cuts[0][0] == 0 and cuts[-1][1] == 3000 and all(a[1] == b[0] and a[1] > a[0] for a, b in zip(cuts, cuts[1:], strict=False))


def test_every_name_is_asked(spark, tmp_path):
    for folder, names in (("some", [(0, "ada"), (20, None), (40, "!!"), (60, "ada"), (61, "adam")]), ("one", [(20, "ada")]), ("none", [])):
        spark.createDataFrame(names, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/{folder}/customer.parquet")
        row = catalogue.QUERIES["title_index"](spark, f"{tmp_path}/{folder}").first()
        assert (row.n_queries, row.nine_in_ten) == (sum(k % 20 == 0 for k, _ in names), True)
