import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from haggle.llm import alignment, byte_bpe
from haggle.llm.alignment import MERGES, MODEL, Aligner, Pair, Rows, align, groups, overlaps, shared_links


def brute(texts, tokenizer, model, bytes_a, bytes_b):
    """Rows as align() gives them, from the libraries' ids of whole texts and all pairs of byte ranges."""

    def spans(ids, table):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(table[i]), i))
            at += len(table[i])
        return out

    aligned = []
    for text in texts:
        raw = f" {text or ''}".encode()
        a, b = (tokenizer.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
            aligned.append(None)
            continue
        a, b = spans(a, bytes_a), spans(b, bytes_b)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        cuts, cells = sorted({x[1] for x in a} & {y[1] for y in b}), []
        for low, high in zip([0, *cuts], cuts):
            cells.append(tuple([str(x[2]) for x in side if low <= x[0] < high] for side in (a, b)))
        aligned.append((len(a), len(b), cells, links))
    counts = Counter(p for x in aligned if x for p in set(x[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for x in aligned:
        if x is None:
            out.append((0,) * 7 + ("",))
            continue
        n_a, n_b, cells, links = x
        digest = sha256(";".join(f"{','.join(a)}|{','.join(b)}" for a, b in cells).encode()).hexdigest()
        out.append((n_a, n_b, len(cells), len(links), sum(len(a) * len(b) for a, b in cells), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


@pytest.fixture(scope="module")
def pair():
    return Pair.load()


@pytest.fixture(scope="module")
def plain(pair):
    tokenizer = Tokenizer.from_file(MERGES)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=MODEL), pair.a.tokens, pair.bytes_b


def texts():
    rng = random.Random(11)
    alphabet = list("aeTH 1'st\n\t  é漢.!?") + ["the ", " and", "🙂", "\x85", "\xa0", " ", "\x00", "<s>", "<0x0A>", "<|endoftext|>"]
    some = [None, "", " ", "  ", "\n", "x", " x", "x ", "a \n b", "U+2581 ▁ inside", "▁", "the cat sat on the mat " * 30, "aaaaaaaaaaaaaaaaaaaaa" * 9]
    return some + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(250)]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [alignment.HEAD, 60, 0])
def test_same_as_brute_force(spark, plain, head):
    every = texts() * 2  # repeated rows count each
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(every)], "doc_id long, text string, pairs string, row int")
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in align(docs, head=head).collect()}
    assert [got[k] for k in range(len(every))] == brute(every, *plain)


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_a for r in align(docs).collect()) == [0, 2]
    assert align(docs.limit(0)).collect() == []


def test_units_are_forgotten_and_long_texts_go_in_parts(pair, plain, monkeypatch):
    whole = Aligner(pair)
    some = texts()
    want = whole.texts(some)
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(byte_bpe.parts, "__defaults__", (40,))
    monkeypatch.setattr(alignment, "_CHUNK", 64)
    small = Aligner(pair, cached=5)
    for at in range(0, len(some), 10):
        got = small.texts(some[at : at + 10])
        assert got[0] == want[0][at : at + 10] and (got[1] == want[1][at : at + 10]).all()
        inside = (want[2] >= at) & (want[2] < at + 10)
        key = lambda o, p, t: sorted(zip(o.tolist(), p.tolist(), t.tolist(), strict=True))
        assert key(got[2] + at, *got[3:]) == key(*(x[inside] for x in want[2:]))


def test_products_are_those_of_dense_matrices(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(alignment, "_CHUNK", 7)
    for _ in range(30):
        a, b = (rng.random((n, m)) < 0.4 for n, m in ((6, 9), (9, 5)))
        rows = [Rows(np.concatenate([[0], np.cumsum(x.sum(1))]), np.nonzero(x)[1]) for x in (a, b)]
        out = np.zeros((6, 5), int)
        for i, j, v in rows[0] @ rows[1]:
            out[i, j] += v
        assert (out == a.astype(int) @ b.astype(int)).all()
        back = rows[0].transposed(9).transposed(6)
        assert (back.start == rows[0].start).all() and (back.index == rows[0].index).all()


def test_links_lie_inside_groups():
    a, b = np.array([3, 2, 1, 4, 2]), np.array([1, 4, 1, 1, 5])
    i, j, v = overlaps(a, b)
    assert list(zip(i.tolist(), j.tolist(), v.tolist())) == [(0, 0, 1), (0, 1, 2), (1, 1, 2), (2, 2, 1), (3, 3, 1), (3, 4, 3), (4, 4, 2)]
    inside = {(int(x), int(y)) for p in shared_links(*groups(a, b)) for x, y in zip(p[0], p[1])}
    assert inside == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4)}
