"""Whole queries on the smallest tables: against SQL where there is some, else against brute force."""

import os
from zlib import crc32

import duckdb
import pytest

from haggle.llm import licenses, pieces, registry
from haggle.llm.lattice import Vocabulary

from .test_lm_score import brute as brute_counts
from .test_secrets import brute as brute_spans
from .test_simhash import brute_components, brute_fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


def test_op1(spark, documents):
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in registry.QUERIES["op1_simhash_dedup"](spark, SF).collect())
    assert got == brute_components([(i, brute_fingerprint(t or "")) for i, t in documents])


def test_op4(spark, documents):
    out = registry.QUERIES["op4_mix"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in documents)
    assert len({(r.slot, r.place) for r in out}) == len(out) and len({(r.source, r.block) for r in out}) == len({r.slot for r in out})


def test_op6(spark, documents):
    out = registry.QUERIES["op6_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in documents)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)


def test_op7(spark, documents):
    out = registry.QUERIES["op7_lm_score"](spark, SF).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    want = brute_counts(documents)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(r.score < 0 for r in out)


def test_op9(spark, documents):
    vocabulary = Vocabulary.load(pieces.MODEL)
    texts = dict(documents)
    out = registry.QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert len(out) == len(documents)
    assert all(r.round_trip and r.n_pieces == len(r.ids) and pieces.decode_ids(vocabulary, r.ids) == texts[r.doc_id] for r in out)


def test_op10(spark, documents):
    import hashlib

    out = {r.doc_id: r for r in registry.QUERIES["op10_secret_scan"](spark, SF).collect()}
    for i, t in documents:
        spans = brute_spans(t or "")
        kinds = [s.split(":")[0] for s in spans.split(",") if s]
        assert out[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert set(spans.split(",")) - {""} <= set(out[i].spans.split(","))


def test_op11(spark):
    from .test_conversations import EMPTY, FIELDS, brute, brute_damage

    data = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = registry.QUERIES["op11_conversation_repair"](spark, SF).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in out} == {conv: EMPTY for conv, *_ in data} | brute(brute_damage(data)) and len(out) == len({r.conv_id for r in out})


def test_op12(spark, documents):
    import sentencepiece
    from tokenizers import Tokenizer

    from haggle.llm.alignment import MERGES, MODEL, Pair

    from .test_alignment import FIELDS
    from .test_alignment import brute as brute_aligned

    few = [(i, t) for i, t in documents if len(t or "") < 3000]  # brute force compares all tokens with all
    tokenizer, pair = Tokenizer.from_file(MERGES), Pair.load()
    tokenizer.encode_special_tokens = True
    out = {r.doc_id: r for r in registry.QUERIES["op12_alignment"](spark, SF).collect()}
    want = brute_aligned([t for _, t in few], tokenizer, sentencepiece.SentencePieceProcessor(model_file=MODEL), pair.a.tokens, pair.bytes_b)
    assert len(out) == len(documents)
    for (i, _), w in zip(few, want, strict=True):  # counts are those of all documents, so they are at least those of a few
        got = tuple(out[i][f] for f in FIELDS)
        assert got[:5] + got[7:] == w[:5] + w[7:] and got[6] >= w[6]


def test_op13(spark, documents):
    import hashlib
    import struct

    import tiktoken

    from haggle.llm.byte_bpe import PATTERN, RANKS, load_ranks

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(load_ranks(RANKS))}, special_tokens={})
    out = {r.doc_id: r for r in registry.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    assert len(out) == len(documents)
    for i, t in documents:
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == want


def test_signature_words_are_in_every_near_unit():
    for name, template in licenses.templates():
        pairs = licenses.bigrams(template)
        words = set(licenses.signature(pairs, 0.8 / 1.2))
        missed = [p for p in pairs if not words & set(p.split())]
        assert len(missed) < 0.8 / 1.2 * len(pairs), name
