import random

import numpy as np
import pytest
import xxhash

from haggle.llm import golay, simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); the smallest doc_id reachable by links of at most 3 bits."""
    label = {i: i for i, _ in enumerate(rows)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(d), f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(rows))


def test_every_word_is_near_one_codeword_and_near_words_share_one():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 4000)
    row, index = golay.near(x)
    sizes = np.bincount(row)
    assert set(sizes) <= {1, 6}
    sets = [set() for _ in x]
    for r, i in zip(row.tolist(), index.tolist()):
        sets[r].add(i)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << int(b)
        r2, i2 = golay.near(y)
        other = [set() for _ in y]
        for r, i in zip(r2.tolist(), i2.tolist()):
            other[r].add(i)
        assert all(a & b for a, b in zip(sets, other))


@pytest.mark.parametrize("keys", [simhash.golay_keys, simhash.block_keys(8), simhash.block_keys(16)])
def test_fingerprints_within_three_bits_meet(keys):
    rng = random.Random(2)
    for trial in range(60):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        row, key, side = keys(np.array([x, y], np.uint64))
        have = [{(int(k), int(s)) for r, k, s in zip(row, key, side) if r == i} for i in (0, 1)]
        assert any((k, {0: 0, 1: 2, 2: 1}[s]) in have[1] for k, s in have[0]), trial


@pytest.mark.parametrize("text", ["", " \t\n", "One", "One TWO", "a b c", "É é x y z " * 9, "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_links_against_all_pairs_with_dense_groups(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            y = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for longest in (4096, 8):  # the second sends dense runs through the finer keys
        links = simhash.near_links(df, longest)
        got = {r.node: r.root for r in simhash.components(links).collect()}
        want = brute_components(list(enumerate(fps)))
        groups = {}
        for place, s in enumerate(signed):
            groups.setdefault(got.get(s, s), set()).add(place)
        expect = {}
        for place, _, least in want:
            expect.setdefault(least, set()).add(int(place))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, None), (4, ""), (None, "x y z"), (6, "x y z"), (6, "x y z"), (6, "other words here"), (9, long), (8, long + " end")]
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_dedup(df).collect())
    assert got == brute_components([(i, brute_fingerprint(t or "")) for i, t in rows])
    assert simhash.simhash_dedup(df.limit(0)).count() == 0
