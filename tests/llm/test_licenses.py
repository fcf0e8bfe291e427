import os
import random

import pytest

from haggle.llm import licenses as lic

COMMON = "/usr/share/common-licenses"


def brute(text):
    """Every template against every window, without any pruning."""
    w, found = lic.words_of(text or ""), []
    for name, template in lic.templates():
        t = lic.words_of(template)
        b, m = set(zip(t, t[1:])), len(t)
        last = max(0, len(w) - m)
        scores = []
        for s in {*range(0, last + 1, lic.step(m)), last}:
            a = set(zip(w[s : s + m], w[s + 1 : s + m]))
            scores.append(round(2 * len(a & b) / (len(a) + len(b)), 6))
        if max(scores) >= 0.8:
            found.append((-max(scores), name))
    return (min(found)[1], -min(found)[0], len(found)) if found else (None, None, 0)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, license string, words int")
    return {r.doc_id: r for r in lic.license_scan(df).collect()}


def test_against_all_windows(spark):
    full = {k: v[-1] for k, v in lic.TEMPLATES.items()}
    rng = random.Random(3)
    filler = " ".join(rng.choice(["the", "license", "software", "under", "conditions", "free", "word"]) for _ in range(700))
    texts = [
        None, "", "\n\n", "license", "Released under the MIT License.", "some text\nLicensed under CC BY-NC 4.0.\nmore", full["MIT"].upper(), "Intro.\n\n" + full["GPL-3.0"].replace(" ", "\n") + "\n\nEnd.", full["GPL-2.0"],
        full["Apache-2.0"] + " and some more words at the end of it", "Released under the Foo License.", "Released under the MIT License.\nReleased under the MIT License.\nLicensed under the ISC License.", filler, filler + full["BSD-3-Clause"] + filler,
    ]
    for name, template in lic.templates():
        w = template.split()
        for at in rng.sample(range(len(w)), len(w) // 9):
            w[at] = rng.choice(["x", "the", "License"])
        texts.append(f"{filler[: rng.randrange(300)]} {' '.join(w)} {filler[: rng.randrange(300)]}")
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[4])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, license string, words int")
    got = sorted((str(r.doc_id), str(r.license), r.score or 0, r.n_matches) for r in lic.license_scan(df).collect())
    want = sorted((str(i), str(b[0]), b[1] or 0, b[2]) for i, t in rows for b in [brute(t)])
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    assert lic.license_scan(df.limit(0)).count() == 0
    assert {r.n_matches for r in lic.license_scan(df, known=[]).collect()} == {0}


def test_notices_inside_lines_and_over_paragraphs(spark):
    bsd = [t for t in lic.TEMPLATES["BSD-3-Clause"] if len(t) > 200][0]
    texts = [
        "We wrote this tool in a week. It has been released under the MIT License. Please send patches to the list, and do not forget the tests.",
        "/*\n * " + bsd.replace(". ", ".\n *\n * ") + "\n */\nint main() { return 0; }\n" * 40,
        "nothing of the kind, although the words license, software and warranty occur in it",
        "word " * 200000 + "Licensed under CC BY 4.0." + " word" * 1000,
    ]
    out = scan(spark, texts)
    assert [out[i].license for i in range(4)] == ["MIT", "BSD-3-Clause", None, "CC-BY-4.0"]


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="full texts are not here")
def test_full_texts_with_and_without_blank_lines(spark):
    texts, want = [], []
    for file, name in FILES.items():
        text = open(f"{COMMON}/{file}", encoding="utf-8").read()
        for t in (text, "\n".join(x for x in text.split("\n") if x.strip()), " ".join(text.split())):
            texts.append(t)
            want.append(name)
    out = scan(spark, texts)
    found = [{m.license for m in out[i].matches} for i in range(len(texts))]
    assert all(w in f for w, f in zip(want, found)), [(w, f) for w, f in zip(want, found) if w not in f]


def test_short_full_texts(spark):
    copyright_ = "Copyright (c) 2020 Some Body\n\n"
    mit = lic.TEMPLATES["MIT"]
    full = {"MIT": max(mit[1:], key=len) + "\n\n" + mit[0], "BSD-2-Clause": lic.TEMPLATES["BSD-2-Clause"][0] + ", INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."}
    for sep in ("\n\n", "\n", " "):
        out = scan(spark, [copyright_ + t.replace(". ", "." + sep) for t in full.values()])
        assert [out[i].license for i in range(2)] == list(full)
