"""Licences in texts, by the Dice coefficient of word bigrams with licence templates.

A template is a short statement, a standard notice, or a passage that tells a licence's full text from others. Windows with as
many words as the template run over all words of a text, an eighth of a window at a step, with a last one that ends with the text;
lines and paragraphs do not matter. A window and a template are compared as sets of adjacent word pairs: 2 |both| / (|window| + |template|).
Where this is to reach t, the smaller set has at least t / (2 - t) of the larger one's size, so templates that are too long for a
text, and windows with too few different pairs, drop out by size. For the same reason the window must hold most of the
template's pairs, hence one of any few words that enough of its pairs contain: texts, templates and windows without
such a word are left before any pair is cut.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short statements and the standard notices of common licences, as their stewards publish them.
TEMPLATES = {
    "MIT": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case, based on the explanations below.",
    ],
    "LGPL-3.0": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License. You must inform recipients that the Source Code Form of the Covered Software is governed by the terms of this License, and how they can obtain a copy of this License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
THRESHOLD = 0.8
# Words so common that finding one says little.
COMMON = "a all an and any as at be by for from in is it its no not of on or other shall that the this to under use with work works you your".split()


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def templates() -> list[tuple[str, str]]:
    return [(name, t) for name, texts in TEMPLATES.items() for t in texts]


def step(words: int) -> int:
    """Words from the start of a window to that of the next."""
    return max(1, words // 8)


def signature(pairs: list[str], ratio: float) -> list[str]:
    """Words, long ones first and common ones last, of which a unit near a template of these pairs must hold one.

    The unit holds the share `ratio` of the pairs at least, so it cannot miss all pairs that contain these words.
    """
    need = len(pairs) - math.ceil(ratio * len(pairs) - 1e-6) + 1
    chosen, covered = [], set()
    for w in sorted({x for p in pairs for x in p.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(covered) >= need:
            break
        chosen.append(w)
        covered |= {p for p in pairs if w in p.split()}
    return chosen


def one_of(words: set[str]) -> str:
    """A pattern of these words that branches letter by letter, so that most places of a text fail at their first letter."""
    heads = sorted({w[:1] for w in words})
    return "(?:" + "|".join(h and h + one_of({w[1:] for w in words if w[:1] == h}) for h in sorted(heads, reverse=True)) + ")" if heads != [""] else ""


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, license, score, n_matches, matches.

    matches: for each template with a window that reaches the threshold, (license, score, start, words) of its best window (ties: the
    first), start being the place of its first word; n_matches counts them. license and score are those of the best match
    (ties: the first name), null if there is none. known: (name, template) pairs, TEMPLATES if not given. Words are runs of a-z and 0-9
    after lower-casing; a text shorter than a template is one window; a window of one word has no pair and matches nothing. A null or
    empty text has no match. Other columns are not looked at.
    """
    ratio = threshold / (2 - threshold) - 1e-9  # a pair that just reaches the threshold is in
    rules = [(name, len(words_of(t)), step(len(words_of(t))), b, signature(b, ratio)) for name, t in (known if known is not None else templates()) if (b := bigrams(t))]
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    told = rf"(?<![a-z0-9]){one_of({w for r in rules for w in r[4]})}(?![a-z0-9])" if rules else "(?!)"
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(told), F.split(F.btrim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")).otherwise(none).alias("words"))
    # one constant, made when the query is planned
    kind = "array<struct<license:string,m:int,step:int,pairs:array<string>,told:array<string>>>"
    quoted = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    listed = F.expr("array(" + ", ".join(f"named_struct('license', '{name}', 'm', {m}, 'step', {st}, 'pairs', {quoted(b)}, 'told', {quoted(told_)})" for name, m, st, b, told_ in rules) + ")").cast(kind)
    n = F.size("words")
    able = F.filter(listed, lambda r: (n - 1 >= ratio * F.size(r["pairs"])) & F.arrays_overlap("words", r["told"]))
    rows = rows.select("doc_id", "words", F.when(n > 0, able).otherwise(F.array().cast(kind)).alias("able"))

    def best(r):
        last = F.greatest(n - r["m"], F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, r["step"]), F.array(last)))
        windows = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, r["m"]).alias("w"))), lambda x: F.arrays_overlap(x["w"], r["told"]))

        def pairs(x):
            size = F.size(x["w"])
            cut = F.zip_with(F.slice(x["w"], F.lit(1), size - 1), F.slice(x["w"], F.lit(2), size - 1), lambda a, b: F.concat_ws(" ", a, b))
            return F.struct(x["start"].alias("start"), size.alias("words"), F.array_distinct(cut).alias("b"))

        cut = F.filter(F.transform(F.filter(windows, lambda x: F.size(x["w"]) > 1), pairs), lambda x: F.size(x["b"]).between(ratio * F.size(r["pairs"]), F.size(r["pairs"]) / ratio))
        scored = F.transform(cut, lambda x: F.struct((-F.round(2.0 * F.size(F.array_intersect(x["b"], r["pairs"])) / (F.size(x["b"]) + F.size(r["pairs"])), 6)).alias("less"), r["license"].alias("license"), x["start"].alias("start"), x["words"].alias("words")))
        return F.array_min(scored)

    near = F.filter(F.transform("able", best), lambda m: F.coalesce(m["less"] <= -threshold, F.lit(False)))
    rows = rows.select("doc_id", near.alias("near"))
    top = F.array_min("near")
    return rows.select("doc_id", top["license"].alias("license"), (-top["less"]).alias("score"), F.size("near").alias("n_matches"), F.transform("near", lambda m: F.struct(m["license"].alias("license"), (-m["less"]).alias("score"), m["start"].alias("start"), m["words"].alias("words"))).alias("matches"))


def oracle() -> str:
    """DuckDB SQL for doc_id, license, score and n_matches."""
    ratio = THRESHOLD / (2 - THRESHOLD) - 1e-9
    rules = [(k, name, len(words_of(t)), step(len(words_of(t))), bigrams(t), signature(bigrams(t), ratio)) for k, (name, t) in enumerate(templates())]
    listed = lambda xs: "[" + ", ".join(map(repr, xs)) + "]"
    values = ", ".join(f"({k}, '{name}', {m}, {st}, {listed(b)}, {listed(told)})" for k, name, m, st, b, told in rules)
    return rf"""
WITH t(k, license, m, step, tb, told) AS (VALUES {values}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
able AS (SELECT w.doc_id, w.w, greatest(len(w.w) - t.m, 0) AS last, t.* FROM w JOIN t ON list_has_any(w.w, t.told)),
s AS (
  SELECT doc_id, k, license, m, tb, w, unnest(list_distinct(list_append(range(0, last + 1, step), last))) AS start FROM able
), b AS (
  SELECT doc_id, k, license, tb, list_distinct(list_transform(list_zip(w[start + 1:least(start + m, len(w)) - 1], w[start + 2:start + m]), lambda x: x[1] || ' ' || x[2])) AS b FROM s WHERE len(w) > 1
), best AS (
  SELECT doc_id, k, license, max(round(2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)), 6)) AS score FROM b GROUP BY ALL HAVING score >= {THRESHOLD}
), per AS (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score, count(*)::INT AS n_matches FROM best GROUP BY doc_id)
SELECT d.doc_id, per.license, per.score, coalesce(per.n_matches, 0)::INT AS n_matches FROM documents d LEFT JOIN per USING (doc_id)
"""
