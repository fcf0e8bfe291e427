import random
import struct

import numpy as np
import pytest
import tiktoken

from haggle.llm import byte_bpe
from haggle.llm.byte_bpe import PATTERN, RANKS, Coder, Merges, PerfectHash, Tokens, load_ranks, parts


@pytest.fixture(scope="module")
def tokens():
    return Tokens.load(RANKS)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens.tokens)}, special_tokens={})


def encoded(coder, texts):
    flat, counts = coder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_every_token_has_a_slot_and_nothing_else_is_found(tokens):
    found = tokens.hash.find(tokens.tokens)
    assert (found == np.arange(len(tokens.tokens))).all() and sorted(tokens.hash.number.tolist()) == list(range(len(tokens.tokens)))
    known = set(tokens.tokens)
    rng = random.Random(3)
    others = [w for w in (bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))) for _ in range(2000)) if w not in known]
    assert (tokens.hash.find(others) == -1).all() and len(tokens.hash.find([])) == 0


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_hash_of_few_words(n):
    words = [bytes([k % 256, k // 256]) + b"\0" * (k % 20) for k in range(n)]
    assert (PerfectHash.build(words).find(words) == np.arange(n)).all()


def test_merging_gives_each_token_itself(tokens):
    assert Merges(tokens.tokens).ids(tokens.tokens) == [np.array([i], np.int32).tobytes() for i in range(len(tokens.tokens))]


def test_both_files_hold_the_same_tokens(tokens):
    assert load_ranks("/opt/tokenizers/byte_bpe_50k.json") == tokens.tokens


def test_same_ids_as_the_library(tokens, library):
    rng = random.Random(5)
    # letters and numbers of late editions of Unicode, white space of all kinds, marks, characters beyond U+FFFF
    odd = [chr(c) for c in (0x558, 0x58B, 0x88F, 0x11DE0, 0x1246F, 0xA7CE, 0x85, 0xA0, 0x1C, 0x2028, 0x300, 0, 0x1F600, 0x20000)]
    texts = ["", " ", "\n", "don't we'LL", "<|endoftext|>", "a" * 5000, " " * 3000, "x\r\n\r\n  y"]
    texts += ["".join(rng.choice(odd + list("abTH 1'st\n\t  é漢.!?")) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    coder = Coder(tokens, cached=50)
    for at in range(0, len(texts), 100):  # words come back after they have been forgotten
        some = texts[at : at + 100]
        got = encoded(coder, some)
        assert got == [library.encode_ordinary(t) for t in some]
        assert [coder.decode(ids).decode() for ids in got] == some


def test_every_character_falls_in_the_library_s_class(tokens, library):
    coder = Coder(tokens)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}" for c in every[at : at + 4000]) for at in range(0, len(every), 4000)]
    assert encoded(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_texts_go_in_parts(tokens, library, monkeypatch):
    text = "The and  of\n\nthe 12 don't \t x, " * 200 + "y" * 3000 + " z z"
    assert "".join(parts(text, 100)) == text and len(list(parts(text, 100))) > 20
    monkeypatch.setattr(byte_bpe, "PART", 100)
    monkeypatch.setattr(byte_bpe.parts, "__defaults__", (100,))
    assert encoded(Coder(tokens), [text, "a b", text]) == [library.encode_ordinary(t) for t in (text, "a b", text)]


def test_a_word_of_a_megabyte_is_no_square(tokens):
    word = "abcdé" * 200_000
    coder = Coder(tokens)
    assert coder.decode(coder.encode([word])[0].tolist()).decode() == word


def test_frames(spark, library):
    rows = [(1, "one two", "x", 5), (1, "one two", "x", 5), (2, None, "y", 6), (None, "", None, None), (3, "Éq 漢字 🙂", "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    out = byte_bpe.encode(docs, packed_col="packed", decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "ids", "packed", "decoded"]
    for r in out.collect():
        want = None if r.text is None else library.encode_ordinary(r.text)
        assert r.ids == want
        assert r.packed == (None if want is None else struct.pack(f"<{len(want)}I", *want)) and r.decoded == (None if want is None else r.text.encode())
    back = [None if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(out.select("ids")).collect()]
    assert sorted(back, key=str) == sorted((None if t is None else t.encode() for _, t, *_ in rows), key=str)
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>")).collect()
