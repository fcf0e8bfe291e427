import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from .test_simhash import brute_components, brute_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 200))) for _ in range(300)]
    for i in range(0, 300, 3):
        if i % 2:
            words = texts[i].split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["villain", "rascal"]))
            texts[i] = " ".join(words)
    texts += [texts[1], texts[1], texts[2] + " x", "", None]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else "big", len(t or "")) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    toxic = [(i, 1, int("villain" in (t or "") or "rascal" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {r[0]: r for r in rows}, {i: y for i, _, y in toxic}


def test_each_stage_on_what_the_one_before_left(spark, folder):
    at, rows, toxic = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left, names = dict(rows), [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "simhash near-dedup", "mixing sources", "sentencepiece"]
    for name, stage in pipeline.STAGES:
        before = left
        out = stage(spark, docs, at)
        got = out.collect()
        left = {r.doc_id: before[r.doc_id] for r in got}
        assert len(left) == len(got)
        if name != names[-1]:
            assert out.columns == docs.columns and all(tuple(r) == rows[r.doc_id] for r in got)
            docs = spark.createDataFrame(got, docs.schema)
        if name == "toxicity":
            wrong = [i for i in before if (i in left) != (not toxic[i])]
            assert len(wrong) <= 0.05 * len(before)
        elif name == "exact dedup":
            last = {}
            for i, r in sorted(before.items()):
                last[r[1] or ""] = i
            assert set(left) == set(last.values())
        elif name == "simhash near-dedup":
            groups = brute_components([(i, brute_fingerprint(r[1] or "")) for i, r in before.items()])
            assert set(left) == {least for _, _, least in groups}
        else:
            assert set(left) == set(before)
        if name == "sentencepiece":
            assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_run_gives_the_rows_of_the_stages(spark, folder):
    at, rows, _ = folder
    out = pipeline.run(spark, at).collect()
    assert max(Counter(r.doc_id for r in out).values()) == 1 and 0 < len(out) < len(rows)


def test_positions_give_the_mixture(spark, folder, tmp_path, monkeypatch):
    """In order of position the rows of run() follow the slots of mix(), whatever files they came from."""
    from haggle.llm.mixing import mix

    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)), "en", "a" if i % 4 else "b", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pipeline, "STAGES", [x for x in pipeline.STAGES if x[0] in ("mixing sources", "sentencepiece")])
    assert pipeline.POSITION in pipeline.to_pieces(spark, docs, "").columns
    want = [r.doc_id for r in sorted(mix(docs).collect(), key=lambda r: (r.slot, r.place))]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.position for r in out}) == len(rows)
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == want


def survivors(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, text_sha256 string").repartition(3)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


LONG = " ".join(f"w{k}" for k in range(100))


@pytest.mark.parametrize("stage", ["drop_copies", "drop_near_copies"])
def test_rows_that_share_ids_or_have_none(spark, stage):
    """One row of each text stays, also where ids repeat or are null; a text that has no copy always stays."""
    texts = {7: ["a b", "unique one", "a b"], 9: ["a b"], None: ["a b", "only here", "only here", LONG], 11: ["x y", "x y"], 12: [None, ""], 13: [LONG + " more", LONG + " more"]}
    rows = [(i, t, "en", "k") for i, ts in texts.items() for t in ts]
    got = survivors(spark, getattr(pipeline, stage), rows)
    kept = Counter(t or "" for _, t in got)
    single = {"a b", "unique one", "only here", "x y", ""}
    assert all(kept[t] == 1 for t in single)
    assert kept[LONG] + kept[LONG + " more"] == (2 if stage == "drop_copies" else 1)
    assert ((9, "a b") in got) == (stage == "drop_copies") and (7, "unique one") in got


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(pipeline.STAGES)[name](spark, docs, str(tmp_path)).count() == 0


def test_mixing_keeps_every_row(spark):
    rows = [(i % 40 if i % 7 else None, f"t{i % 90}", "en", "ab"[i % 2] if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
