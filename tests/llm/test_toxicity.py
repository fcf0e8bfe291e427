import os
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from haggle.llm import toxicity as tox


def corpus(n, seed=1):
    rng = random.Random(seed)
    letters = random.Random(0)
    calm = ["".join(letters.choice("abcdehilmnorst") for _ in range(letters.randint(2, 8))) for _ in range(300)]
    rows = []
    for _ in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(1, 150))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["wretch", "Knave!", "quzz" + rng.choice(calm)]))
        rows.append((" ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def net():
    return tox.train(*map(list, zip(*corpus(400))))


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = tox.Network.fresh({b"one": 1, b"two": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    own, grams, counts = net.inputs([b"one", b"two", b"three"])
    ids, mask = tox._batch([[0, 1, 2], [2], [], [1, 1, 0, 2]])
    ids, mask = ids[:5], mask[:5]
    y, w = np.array([1.0, 0, 1, 0]), np.array([0.5, 1, 0.2, 0.3])
    _, grads = tox.loss_and_gradients(net, own, grams, counts, ids, mask, y, w)
    for name, g in grads.items():
        flat, gf = net.p[name].reshape(-1), g.reshape(-1)
        for k in rng.choice(np.flatnonzero(gf) if gf.any() else [0], 3):
            old, sides = flat[k], []
            for e in (1e-2, -1e-2):
                flat[k] = old + e
                sides.append(tox.loss_and_gradients(net, own, grams, counts, ids, mask, y, w)[0])
            flat[k] = old
            assert gf[k] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=2e-3), name


def test_held_out_accuracy(net):
    texts, labels = zip(*corpus(200, seed=9))
    got = tox.Scorer(net).scores(list(texts)) >= 0.5
    assert (got == np.array(labels)).mean() > 0.9


def test_a_text_scores_as_its_worst_window_whatever_the_cache(net):
    text = " ".join(t for t, _ in corpus(40, seed=5))
    words = text.split()
    parts = [" ".join(words[a : a + tox.WINDOW]) for a in tox.window_starts(len(words))]
    assert tox.Scorer(net).scores([text])[0] == pytest.approx(tox.Scorer(net, cached=5).scores(parts).max(), abs=1e-4)
    assert len(words) <= tox.window_starts(len(words))[-1] + tox.WINDOW


def test_one_label_or_none():
    assert tox.Scorer(tox.train([], [])).scores(["x"])[0] == 0.5
    assert tox.Scorer(tox.train(["a b", ""], [0, 0])).scores(["x", ""]).max() < 0.1


def test_tables(spark, net):
    rows = [(1, "calm words"), (2, None), (3, ""), (3, ""), (None, "wretch knave " * 20000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, held_out int")
    out = tox.toxicity(df, net).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1
    assert tox.toxicity(df.limit(0), net).count() == 0
    held = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", tox.held_out().alias("h")).collect()
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    assert isinstance(tox.fit(df, labels), tox.Network)
    assert isinstance(tox.fit(df.limit(0), labels.limit(0)), tox.Network)


def test_every_passage_of_40_words_lies_whole_in_a_window():
    for n in (1, 63, 64, 65, 88, 89, 300, 331):
        starts = tox.window_starts(n)
        assert starts == sorted(set(starts)) and starts[-1] == max(0, n - tox.WINDOW)
        for at in range(max(1, n - 39)):
            assert any(a <= at and min(n, at + 40) <= a + tox.WINDOW for a in starts)


def test_a_passage_scores_alike_at_every_offset():
    """Toxic only where 'alpha' and 'omega' stand 38 words apart in one text; each alone is clean."""
    rng = random.Random(6)
    calm = [f"calm{k}" for k in range(40)]

    def text(n, marks):
        words = [rng.choice(calm) for _ in range(n)]
        for at, w in marks:
            words[at] = w
        return " ".join(words)

    rows = []
    for _ in range(300):
        at = rng.randrange(24)
        rows += [(text(64, [(at, "alpha"), (at + 39, "omega")]), 1), (text(64, [(at, "alpha")]), 0), (text(64, [(at + 39, "omega")]), 0)]
    net = tox.train(*map(list, zip(*rows)), epochs=12)
    words = text(300, []).split()
    scores = tox.Scorer(net).scores([" ".join([*words[:at], "alpha", *words[at : at + 38], "omega", *words[at + 38 :]]) for at in range(0, 260)])
    assert (scores >= 0.5).mean() > 0.97


def auc(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    better = (scores[labels == 1][:, None] > scores[labels == 0]).mean() + 0.5 * (scores[labels == 1][:, None] == scores[labels == 0]).mean()
    return float(better)


def word_odds(texts, labels):
    """Scores of texts by the largest log odds of a single word: what a network must beat."""
    hits, n = (Counter(), Counter()), Counter(labels)
    for t, y in zip(texts, labels):
        hits[y].update(set(tox.words_of(t)))
    return lambda t: max([np.log((hits[1][w] + 1) / (n[1] + 2)) - np.log((hits[0][w] + 1) / (n[0] + 2)) for w in tox.words_of(t)], default=-9.0)


def test_order_and_unseen_words_which_single_words_cannot_tell():
    """Toxic: 'you' before a word that begins with 'gru', most of them never seen before. Without help from log odds."""
    rng = random.Random(7)

    def made(n):
        rows = []
        for k in range(n):
            words = [rng.choice("the a of on it we see go by red sun you".split()) for _ in range(rng.randint(20, 60))]
            odd = "gru" + "".join(rng.choice("bdfklmp") + rng.choice("aeiou") for _ in range(3))
            at = rng.randrange(1, len(words))
            words = [w if w != "you" or abs(i - at) > 2 else "it" for i, w in enumerate(words)]
            words[at] = odd
            words[at - 1] = "you" if k % 2 else rng.choice(["see", "the", "red"])
            rows.append((" ".join(words), k % 2))
        return map(list, zip(*rows))

    texts, labels = made(700)
    seen_not, truth = made(300)
    net = tox.train(texts, labels, epochs=14, by_odds=False)
    ours, theirs = auc(tox.Scorer(net).scores(seen_not), truth), auc(list(map(word_odds(texts, labels), seen_not)), truth)
    assert ours > 0.9 and ours > theirs + 0.2, (ours, theirs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables are not here")
def test_held_out_rows_of_the_given_tables(spark):
    """On labelled rows that the query did not learn from, the network beats the largest log odds of a word."""
    at = os.environ.get("TEST_TOXIC_DIR", "/root/testdata/sf0.1")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    learn = [r for r in rows if crc32(str(r.doc_id).encode()) % 5]
    test = [r for r in rows if not crc32(str(r.doc_id).encode()) % 5]
    net, truth = tox.fit(docs, labels), [r.toxic for r in test]
    ours = tox.Scorer(net).scores([r.text or "" for r in test])
    theirs = auc(list(map(word_odds([r.text or "" for r in learn[:2000]], [r.toxic for r in learn[:2000]]), [r.text or "" for r in test])), truth)
    print("network", auc(ours, truth), ((ours >= 0.5) == np.array(truth)).mean(), "words", theirs)
    assert auc(ours, truth) > theirs and ((ours >= 0.5) == np.array(truth)).mean() > 0.96


def test_long_words_are_not_remembered(net):
    scorer, rng = tox.Scorer(net), random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(30)] + ["short words here wretch"]
    one = scorer.scores(texts)
    assert len(scorer.place) == 4 and len(scorer.f) == 4 and scorer.scores(texts[-1:])[0] == pytest.approx(one[-1], abs=1e-5)
