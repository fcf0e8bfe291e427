import random
from functools import partial

import numpy as np
import pytest

from haggle.llm import near_copies as near
from haggle.llm.simhash import fingerprint


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_roots(rows):
    """rows: (doc_id, text); the smallest id that links of Jaccard 0.8 or more reach, by row."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["", " ", None, "one two", "One  TWO", "one two three"]
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        # single words changed, a share of 1 to 8 percent: similarities on both sides of 0.8
        for share in (0.01, 0.02, 0.03, 0.04, 0.05, 0.08):
            texts.append(" ".join(edited(rng, base, max(1, int(share * len(base))))))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_are_those_of_all_pairs(spark, rows):
    want = brute_roots(rows)
    out = near.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert len(got) == len(out) and all(got.get(i, i) == root for i, root in want.items())
    assert {r.component_id for r in out} == {r.doc_id for r in out if r.kept}


def test_many_of_them_are_out_of_reach_of_three_bits(rows):
    links = [(i, root) for i, root in brute_roots(rows).items() if i != root and rows[i][1] and rows[root][1]]
    far = [(fingerprint(rows[i][1].encode()) ^ fingerprint(rows[j][1].encode())).bit_count() > 3 for i, j in links]
    assert sum(far) > 0.3 * len(far)


def test_pipeline_stage_drops_copies_beyond_three_bits(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    docs, n = [], 0
    while n < 30:
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        one, other = " ".join(base), " ".join(edited(rng, base, 3))
        if (fingerprint(one.encode()) ^ fingerprint(other.encode())).bit_count() > 3:
            docs += [(2 * n, one), (2 * n + 1, other)]
            n += 1
    left = pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == list(range(0, 60, 2))


def test_a_bucket_whose_centre_is_far_from_its_members(spark, monkeypatch):
    """All texts in one bucket: members far from the centre are still compared with each other."""
    monkeypatch.setattr(near, "_sign", _one_bucket)
    rng = random.Random(5)
    docs = []
    for g in range(4):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(100)]
        docs += [(10 * g + k, " ".join(edited(rng, base, k))) for k in range(3)]
    out = near.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: root for i, root in brute_roots(docs).items()}
    monkeypatch.setattr(near, "_links", partial(near._links, finer=False))  # there is one band only
    small = near.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), longest=3).collect()
    assert {r.doc_id: r.component_id for r in small} == {r.doc_id: r.component_id for r in out}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_copies(empty).count() == 0


def _one_bucket(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.array([[7]] * b.num_rows, pa.list_(pa.int64()))], names=["node", "doc_id", "keys"])


def test_share_of_equal_minima_is_the_similarity():
    rng = np.random.default_rng(4)
    hits = []
    for _ in range(150):
        h = rng.integers(0, 1 << 63, 120, np.uint64)
        hits.append((near.band_keys(h[:100]) == near.band_keys(h[20:])).mean())
    assert abs(np.mean(hits) - (80 / 120) ** near.ROWS) < 0.03


def test_a_large_star_of_near_copies(spark):
    """Copies of one text, each with one word changed: only the text itself is near to all of them."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 1)) for _ in range(250)] + [" ".join(edited(rng, base, 9)) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want, df = brute_roots(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for longest in (4096, 12):
        got = {r.doc_id: r.component_id for r in near.near_copies(df, longest=longest).collect()}
        assert all(got.get(i, i) == root for i, root in want.items())


def test_connecting_links_connect_what_all_links_do():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 30, 25)) for _ in range(rng.integers(1, 30))]
        labels = rng.integers(0, 6, len(sets)) if rng.random() < 0.5 else np.arange(len(sets))

        def merged(links):
            out = labels.copy()
            for i, j in links:
                out[out == out[j]] = out[i]
            return [[bool(x == y) for y in out] for x in out]

        all_links = [(i, j) for i in range(len(sets)) for j in range(i) if near.similar(sets[i], sets[j])]
        assert merged(near.connecting_links(labels, sets)) == merged(all_links)


def _own_buckets(batches):
    """No text meets another by its bands."""
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.array([[n] for n in b.column("node").to_pylist()], pa.list_(pa.int64()))], names=["node", "doc_id", "keys"])


def test_simhash_alone_finds_what_is_within_three_bits(spark, tmp_path, monkeypatch):
    """Without any band, chains of links of three bits, each checked by the shingles, still go; what the shingles part stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    docs, n = [], 0
    while n < 20:
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        one, other = " ".join(base), " ".join(edited(rng, base, 1))
        far = (fingerprint(one.encode()) ^ fingerprint(other.encode())).bit_count() > 3
        if far == (n >= 15):
            docs += [(2 * n, one), (2 * n + 1, other)]
            n += 1
    # one fingerprint, as three shingles outweigh all others, but hardly a shingle of the others in common
    docs += [(40 + k, "buy now cheap " * 400 + " ".join(f"p{k}x{i}" for i in range(30))) for k in range(3)]
    # of one class, too, but like the one after it, not like the least
    docs += [(43, docs[-1][1] + " end")]
    assert len({fingerprint(t.encode()) for i, t in docs if 40 <= i < 43}) == 1
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near, "_sign", _own_buckets)
    close = {2 * k + 1 for k in range(15)} | {43}
    left = pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == sorted({i for i, _ in docs} - close)
    monkeypatch.setattr(near, "_links", partial(near._links, finer=False))  # there are no bands to deal by
    out = near.near_copies(df, longest=2).collect()
    assert {r.doc_id for r in out if not r.kept} == close


def test_bands_compare_only_what_simhash_left_apart(spark):
    pairs = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (5, 4), (7, 6)], "a long, b long")
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (6, 6), (8, 6)], "node long, root long")
    assert sorted(tuple(r) for r in near._apart(pairs, roots).collect()) == [(2, 0), (3, 0), (5, 4), (7, 6)]


def test_driver_plans_few_queries(spark, rows):
    """Each query costs the driver's memory (compiled code, a thread for each exchange), however small the tables are."""
    ran = spark._jsparkSession.sharedState().statusStore().executionsCount
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = ran()
    near.near_copies(df).collect()
    n = ran() - before
    assert n <= 50
