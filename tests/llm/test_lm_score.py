import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from haggle.llm import lattice
from haggle.llm import lm_score as lm
from haggle.llm.lattice import MARK, Vocabulary

TEXTS = ["the cat sat", "The CAT  sat\ton\nthe mat", "", None, "zebra \x0b quagga the", "é É ñandú 漢字", "the " * 3000 + "end", "the cat sat"]


def rows():
    return [(i % 9 if i < 18 else i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "cat")]


def brute(data):
    """Counts and base scores with plain dictionaries."""
    learns = [d is None or crc32(str(d).encode()) % 5 != 1 for d, _ in data]
    tokens = [((t or "").encode().lower().split() + ["end"]) for _, t in data]
    c = Counter(w for ok, ws in zip(learns, tokens) if ok for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(
        (str(d), not ok, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
        for (d, _), ok, ws in zip(data, learns, tokens)
    )


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_counts_and_base_score_whatever_the_head(spark, head):
    df = spark.createDataFrame([(d, t, 0, "w") for d, t in rows()], "doc_id long, text string, c int, word string")
    out = lm.lm_score(df, head=head).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == brute(rows())
    assert all(r.score < 0 for r in out)
    by_text = {}
    for r in out:
        by_text.setdefault((r.n_tokens, round(r.base_score, 6)), set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in by_text.values())


def brute_scores(data):
    """Scores from the definition: all sentences and words of all rows with plain dictionaries; words by the fitted speller."""
    learns = [d is None or crc32(str(d).encode()) % 5 != 1 for d, _ in data]
    texts = [lm.sentences((t or "").encode()) for _, t in data]
    words = Counter(w for ok, t in zip(learns, texts) if ok for s in t for w in s)
    sents = Counter(b" ".join(s) for ok, t in zip(learns, texts) if ok for s in t if len(s) >= lm.LEAST and s[-1][-1:] in (b".", b"!", b"?"))
    n, n_s, ends = sum(words.values()), sum(sents.values()), sum(learns)

    def off(c):
        once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
        return (once + 1) / (once + 2 * twice + 2)

    vocabulary = Vocabulary.load(lm.MODEL)
    model = lm.SpellingModel.of(vocabulary)
    for _ in range(lm.ROUNDS):
        model = lm.SpellingModel.of(vocabulary, model.expected(sorted(words), np.ones(len(words))))
    on, end = (n + 0.5) / (n + ends + 1), (ends + 0.5) / (n + ends + 1)
    left, left_s = (off(words) * len(words) + 1) / (n + 1), (off(sents) * len(sents) + 1) / (n_s + 1)
    every = sorted({w for t in texts for s in t for w in s})
    p = {w: math.log(on * (max(words[w] - off(words), 0) / (n + 1) + left * math.exp(x))) for w, x in zip(every, model.log_probs(every))}
    out = []
    for (d, _), t in zip(data, texts):
        score = math.log(end)
        for s in t:
            spelt, key = math.log(left_s) + sum(p[w] for w in s), b" ".join(s)
            score += np.logaddexp(spelt, math.log(on * (sents[key] - off(sents)) / (n_s + 1))) if sents[key] > 0 and lm.has_edge(s) else spelt
        out.append((str(d), score / math.log(10)))
    return sorted(out)


MORE = ["One two three four. Five six seven!", "One two three four. Other words here? And a last line\nOne two three four.", "one two\nOne two three four.", "Five six seven! x y", "a b. c d e f. c d e f. c d e f. g h i"]


@pytest.mark.parametrize("head", [0, 6, 1000])
def test_scores_by_the_definition_whatever_the_head(spark, head):
    data = [(i, (TEXTS + MORE)[i % 13]) for i in range(45)] + [(None, MORE[0]), (3, MORE[4])]
    out = lm.lm_score(spark.createDataFrame(data, "doc_id long, text string").repartition(4), head=head).collect()
    got, want = sorted((str(r.doc_id), r.score) for r in out), brute_scores(data)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)


def test_sentences_hold_all_words_of_a_text():
    text = b"A b. C d!? e.f g.\n\n h\t. i\x0bj.\x0ck"
    assert sum(lm.sentences(text), []) == text.lower().split() and [len(x) for x in lm.sentences(text)] == [2, 2, 2, 2, 2, 1]
    assert lm.sentences(b"") == lm.sentences(b" \n ") == [] and [lm.has_edge(x) for x in lm.sentences(b"a b c. d e f")] == [True, False]


def test_layout_does_not_matter(spark):
    words = "the cat sat on the mat. no sign here and zebra quagga! one two three.".split()
    layouts = [" ".join(words), "\n".join(words), "\t".join(words) + "\n", "\n\n".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))]
    data = [(k, t) for k, t in enumerate(layouts * 2)] + [(90 + k, "the cat sat on the mat. other words") for k in range(3)]
    out = [r for r in lm.lm_score(spark.createDataFrame(data, "doc_id long, text string")).collect() if r.doc_id < 90]
    assert len(out) == 8 and max(r.score for r in out) - min(r.score for r in out) < 1e-9
    assert len({r.held_out for r in out}) == 2


def test_probabilities_of_all_sequences_sum_to_one():
    """The definition, with three words whose probabilities sum to one: all sequences of up to nine tokens have nearly all of it."""
    p, on, end, left_s = {b"a": 0.3, b"b": 0.3, b"c.": 0.4}, 0.4, 0.6, 0.75
    edges = {b"a b c.": 0.15, b"b a c.": 0.1}

    def score(words):
        total = end
        for s in lm.sentences(b" ".join(words)):
            total *= left_s * math.prod(on * p[w] for w in s) + (on * edges.get(b" ".join(s), 0) if lm.has_edge(s) else 0)
        return total

    # a sentence begins with the choice of an edge; a sequence that ends there has made none
    sums, level = [], [[]]
    for _ in range(10):
        sums.append(sum(map(score, level)))
        level = [[*x, w] for x in level for w in p]
    assert 0.95 < sum(sums) <= 1.0


def test_long_words_that_all_texts_share_are_not_joined(spark, monkeypatch):
    """A rule of eighty dashes in every text is among the frequent words, under its hash."""
    data = [(k, f"text {k} here.\n{'-' * 80}\nmore {k}") for k in range(60)]
    out = lm.lm_score(spark.createDataFrame(data, "doc_id long, text string"))
    got, want = sorted((str(r.doc_id), r.score) for r in out.collect()), brute_scores(data)
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)


def test_long_words_in_parts(monkeypatch):
    model, words = lm.SpellingModel.of(Vocabulary.load(lm.MODEL)), [b"abc" * 900, "éx漢".encode() * 400, b"q"]
    want = model.log_probs(words)
    monkeypatch.setattr(lm, "LONG", 100)
    monkeypatch.setattr(lm, "parts_of", lambda v, w: lattice.parts_of(v, w, 50))
    assert model.log_probs(words) == pytest.approx(want, rel=1e-9)


def test_empty_table(spark):
    assert lm.lm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelling_sums_over_all_segmentations():
    names = [MARK, MARK + "a", "a", "b", "ab", "ba", MARK + "ab"]
    v = Vocabulary.of(names, [-1.0, -2.0, -3.0, -4.0, -5.0, -6.0, -7.0], [], None)
    rng = np.random.default_rng(1)
    model = lm.SpellingModel.of(v, rng.random((3, len(names) + 1)) * [[1000], [1000], [1]])

    def cuts(s):
        return [[]] if not s else [[i, *rest] for i, p in enumerate(names) if s.startswith(p) for rest in cuts(s[len(p) :])]

    for word in ("a", "abba", "baab", ""):
        total = 0.0
        for way in cuts(MARK + word):
            x = model.first[way[0]] + sum(model.next[i] for i in way[1:]) + sum(model.go[i] for i in way[:-1]) + model.stop[way[-1]]
            total += math.exp(x)
        assert model.log_probs([word.encode()])[0] == pytest.approx(math.log(total))


def test_spelling_probabilities_of_all_short_words_sum_to_less_than_one():
    names = [MARK, "a", "b", "ab", MARK + "b"]
    v = Vocabulary.of(names, [-1.0, -2.0, -3.0, -4.0, -5.0], [], None)
    model = lm.SpellingModel.of(v)
    words, last = [b""], [b""]
    for _ in range(9):
        last = [w + x for w in last for x in (b"a", b"b")]
        words += last
    assert 0.3 < np.exp(model.log_probs(words)).sum() <= 1.0  # the rest: longer words, marks and unknown characters inside
