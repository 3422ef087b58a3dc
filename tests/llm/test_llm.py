"""The ten operators on small and odd inputs, against brute force, exact round trips or held-out accuracy."""

import base64
import hashlib
import random
import re
import textwrap

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, decontaminate, langid, licenses, lines, sharding, simhash, suffixes, topk, warc
from ledgerlark.llm.components import components
from ledgerlark.llm.queries import vocabulary
from ledgerlark.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, spans string, _text string"


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "mot " * 30_000), (6, "été ñandú 東京 😀 <|endoftext|> x"), (6, "été ñandú 東京 😀 <|endoftext|> x"), (7, "a"), (None, "sans clé"), (-3, "x" * 2000)]


def test_warc(spark):
    pages = [(3, "http://a", "<p>x</p>"), (1, "http://b\n", "<p>x</p>"), (2, None, None), (4, "http://c", ""), (5, "http://d", "é" * 400_000), (6, "u", "<p>x</p>"), (6, "u", "<p>x</p>"), (None, None, "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("bundle", F.lit("clash"))
    scratch = Scratch(spark, "t")
    bundles = warc.write_bundles(df, scratch)
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(pages)
    for r in (x for x in got if x.page_id is not None):
        html = next((h or "").encode() for i, _, h in pages if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        first = min(i for i, _, h in pages if i is not None and (h or "").encode() == html)
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload == (None if r.record_type == "revisit" else html)
    # each record by its place in the index
    for b in bundles.collect():
        assert {warc.read_record(bytes(b.data), i.frame, i.offset, i.length)[0]["WARC-Record-ID"] for i in b["index"]} == {i.record_id for i in b["index"]}
    assert warc.query(df.where("false")).count() == 0
    least = warc.read_bundles(warc.write_bundles(df, scratch, min_bytes=100)).where("record_type = 'revisit'").count()
    assert least == 0


def brute_simhash(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    return out


def brute_roots(ids, prints, radius):
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if bin(a ^ b).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(30)]
    near = [b + rng.choice(["", " q", " q r", " Z"]) for b in base for _ in range(4)]
    texts = [t for _, t in ODD[:6]] + near
    ids = list(range(10, 10 + len(texts)))
    got = {r.doc_id: r for r in simhash.query(docs(spark, list(zip(ids, texts)))).collect()}
    prints = brute_simhash(texts)
    roots = brute_roots(ids, prints, 2)
    assert all(got[i].fingerprint == f"{p:016x}" and got[i].component_id == roots[i] for i, p in zip(ids, prints))
    assert simhash.query(docs(spark, [])).count() == 0
    odd = simhash.query(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and {r.component_id for r in odd if r.doc_id in (1, 2, 3)} == {1}


def test_tiles_meet(spark):
    """Small tiles: every pair within the radius is found though its members lie in different tiles."""
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    f = np.unique(np.concatenate([f, f ^ (1 << 5), f ^ (1 << 5) ^ (1 << 40)]))
    df = spark.createDataFrame([(int(i), int(x), 1) for i, x in enumerate(f)], "id long, f0 long, n long")
    scratch = Scratch(spark, "t")
    for tile in (3, 1000):
        found = {r.node: r.root for r in components(simhash.links(df, 2, scratch, tile_rows=tile), scratch).collect()}
        roots = brute_roots(range(len(f)), [int(x) for x in f], 2)
        assert {i: found.get(i, i) for i in range(len(f))} == roots


def test_wide_radius(spark):
    """Five words, similarity 0.8: near copies fall together, others and other lengths do not."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    base = [[word() for _ in range(200)] for _ in range(20)]
    near = [b[:90] + [word()] + b[91:] for b in base]
    texts = [" ".join(x) for x in base + near] + [" ".join(base[0][:100])]
    out = simhash.near_duplicates(docs(spark, list(enumerate(texts))), size=5, radius=24, words=2, by_length=0.8)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i % 20 if i < 40 else i for i in range(41)}


def brute_similar(texts, similarity=0.8):
    """Components of the pairs whose sets of five-word shingles are similar enough."""
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_are_similar(spark, monkeypatch):
    """Fingerprints that are near do not link texts of a similarity below 0.8, in whole tiles or cut ones."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    texts = []
    for changed in (0, 1, 7, 8, 9, 10) * 4:  # similarities of 1, 0.95 and 0.69 to 0.59
        base = [word() for _ in range(200)]
        other = base[:]
        for k in range(changed):
            other[10 + 18 * k] = word()
        texts += [" ".join(base), " ".join(other)]
    roots = brute_similar(texts)
    run = lambda **more: {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, list(enumerate(texts))), size=5, radius=24, words=2, by_length=0.8, **more).collect()}
    assert run() != roots
    assert run(similarity=0.8) == roots
    monkeypatch.setattr(simhash, "SET_TILE_ROWS", 3)
    monkeypatch.setattr(simhash, "BUCKETS", 2)
    chain = [[word() for _ in range(200)]]
    for k in range(19):  # each is similar to the one before
        chain.append(chain[-1][:])
        chain[-1][5 + 10 * k] = word()
    texts = [" ".join(c) for c in chain]
    assert run(similarity=0.8) == brute_similar(texts) == dict.fromkeys(range(20), 0)


def test_near_duplicates_are_found(spark):
    """Pairs of 0.8 and just above are found: texts that repeat themselves, short ones, long ones."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    line = [word() for _ in range(100)]
    texts = [" ".join(line), " ".join(line * 2)]
    cycle = [word() for _ in range(40)]
    # one set of shingles at any length; its neighbour is near the longer one
    texts += [" ".join(cycle * k) for k in (2, 3, 6)] + [" ".join(cycle * 6 + [word()])]
    for few, many in ((4, 5), (8, 10), (12, 15), (40, 50), (160, 200), (400, 500)):
        for _ in range(40 if many < 200 else 20):
            base = [word() for _ in range(many + 4)]
            texts += [" ".join(base), " ".join(base[: few + 4])]
    # one line is written often in one of the two
    base, often = [word() for _ in range(150)], [word() for _ in range(20)]
    texts += [" ".join(base + often), " ".join(base + often * 12)]
    roots = brute_similar(texts)
    assert sum(i != r for i, r in roots.items()) >= 205
    found = pipeline.near_duplicates(spark, docs(spark, list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(i for i, r in roots.items() if i == r)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert components(df.where("false"), Scratch(spark, "t")).count() == 0


def brute_repeats(texts, length):
    """(n_removed, spans, kept) of each text by looking at every string."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out.append((int(mask.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~mask])))
    return out


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(300):
        s = np.array([rng.randint(1, rng.choice([1, 2, 4, 300])) for _ in range(rng.randint(0, 40))], np.int64)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_repeated_bytes(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopé ") for _ in range(n))
    shared = text(700)
    texts = [t for _, t in ODD] + [text(300) + shared + text(200), shared[100:] + text(50), text(20) + shared[:450] + shared[460:], text(399), text(1500), shared[50:449], "ab" * 900]
    rows = list(enumerate(texts))
    want = brute_repeats(texts, 400)
    for hot in (256, 1):  # the second settles every anchor with two contexts by single windows
        scratch = Scratch(spark, "t")
        old = suffixes.HOT_CONTEXTS
        got = {r.doc_id: r for r in _drop(spark, rows, scratch, hot).collect()}
        assert suffixes.HOT_CONTEXTS == old
        for i, (n, spans, kept) in enumerate(want):
            assert (got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) == (n, spans, kept), (hot, i)
    assert suffixes.query(docs(spark, [])).count() == 0
    twice = suffixes.drop_repeats(docs(spark, [(1, shared), (1, shared), (None, "k")])).collect()
    assert sorted(r.n_removed for r in twice) == [0, len(shared.encode()), len(shared.encode())]


def brute_passages(texts, n=51):
    """Words of each text that lie in a run of n words of another text."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = {}
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for w in split:
        own = set()
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                own |= set(range(i, i + n))
        out.append(len(own))
    return out


def test_passages(spark):
    rng = random.Random(14)
    words = lambda n: [rng.choice(["un", "deux", "trois", "quatre", "é", "x1"]) + str(rng.randint(0, 9)) for _ in range(n)]
    p51, p60, p300 = words(51), words(60), words(300)
    rows = [words(30) + p51 + words(20), words(7) + p51, p51, p60 + words(50), words(100) + p60 + words(1), p60[:50], p60[9:] + words(40), p300 + words(10), words(11) + p300, p300[100:200], words(60) * 2, words(200), words(50)]
    rows += [words(40) + p300[50:130] + words(40) for _ in range(6)]
    texts = [t for _, t in ODD] + [" ".join(w) for w in rows] + ["\n".join(rows[0]), "mot " * 90]
    got = {r.doc_id: r.n_passage_words for r in suffixes.query(docs(spark, list(enumerate(texts))).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts)
    assert [got[len(ODD) + k] for k in (2, 5, 10, 11, 12)] == [51, 0, 0, 0, 0]
    twice = suffixes.query(docs(spark, [(1, " ".join(p60)), (1, " ".join(p60)), (None, None)])).collect()
    assert {r.n_passage_words for r in twice} == {0}


def _drop(spark, rows, scratch, hot):
    plain = suffixes.repeated_windows
    try:
        suffixes.repeated_windows = lambda d, s, key, text, length, _, others: plain(d, s, key, text, length, hot, others)
        return suffixes.drop_repeats(docs(spark, rows))
    finally:
        suffixes.repeated_windows = plain


def test_licenses(spark):
    texts = ODD + [(20, "Intro. Licensed under the MIT License. More text"), (21, "Permission is hereby granted, nothing"), (22, "ALL RIGHTS RESERVED\nReleased under the MIT License."), (23, "You may obtain a copy of the License at. Licensed under the Apache License, Version 2.0 (the \"License\"); no")]
    texts.append((24, "Licensed under the Apache License, Version 2.0 (the \"License\").\nYou may not use this file except in compliance with the License. blah blah. You may obtain a copy of the License at\n"))
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, texts)).collect()}
    assert got[20].licenses == ["MIT"] and got[21].sentence_ids == [] and got[22].licenses == ["MIT", "Proprietary"] and got[1].rules == []
    assert got[23].sentence_ids == [13, 11] and got[23].licenses == [] and got[24].rules == ["apache-header"]
    assert licenses.license_scan(docs(spark, texts)).count() == len(texts)
    every = [(i, s.upper() + ".") for i, s in licenses.SENTENCES.items()]
    assert all(r.sentence_ids == [r.doc_id] for r in licenses.license_scan(docs(spark, every)).collect())


@pytest.mark.parametrize(("start", "end"), [("", ""), (" * ", "\r"), ("# ", ""), ("// ", " ")])
def test_wrapped_licenses(spark, start, end):
    """Licence texts as they are usually written, wrapped at 70 columns, also in comments."""
    say = {
        "mit-text": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
                     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
                     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."],
        "gpl3-header": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
        "bsd3-text": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
                      "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
                      "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
                      "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    }
    lines_of = lambda paragraphs: [x for p in paragraphs for x in [*textwrap.wrap(p, 70), ""]]
    texts = {r: "\n".join(start + x + end for x in lines_of(p)) for r, p in say.items()}
    texts["none"] = "All rights\n\nreserved. All rights.\nReserved"  # neither over a blank line nor over a sentence's end
    got = {r.doc_id: r.rules for r in licenses.license_scan(docs(spark, list(enumerate(texts.values())))).collect()}
    assert [set(got[k]) for k in range(4)] == [{"mit-text"}, {"gpl3-header"}, {"bsd3-text"}, set()]


#: Licence texts and headers as published. Fixed values.
PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Apache-2.0": """Copyright 2024 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-2-Clause": """Copyright (c) 2024, A. Person. All rights are kept.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.""",
}


def test_published_licenses(spark):
    """As published, in comments, and on one line; SPDX lines; nothing in prose about licences."""
    names, texts = list(PUBLISHED), list(PUBLISHED.values())
    commented = ["/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\nint main() {}" for t in texts]
    one_line = [" ".join(t.split()) for t in texts]
    spdx = [f"// SPDX-License-Identifier: {x}\ncode" for x in licenses.SPDX]
    prose = ["The licence was granted free of charge to any person. The GNU General Public License is well known.", "Not released under the MIT License, as some say", "SPDX-License-Identifier: GPL-2.0-only-ish"]
    every = texts + commented + one_line + spdx + prose
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs(spark, list(enumerate(every)))).collect()}
    want = [[x] for x in [*names * 3, *licenses.SPDX]] + [[]] * len(prose)
    assert [got[i] for i in range(len(every))] == want


def test_licenses_of_odd_tables(spark):
    assert licenses.query(docs(spark, [])).count() == 0
    rows = docs(spark, [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, None), (2, "x " * 200_000 + "\nReleased under the MIT License")])
    clash = rows.withColumns({c: F.lit("x") for c in ("rules", "licenses", "sentence_ids", "_held", "n_sentences")})
    assert sorted((r.doc_id or 0, r.licenses) for r in licenses.license_scan(clash).collect()) == [(0, []), (1, ["MIT"]), (1, ["MIT"]), (2, ["MIT"])]


CLASHES = ("row", "score", "lang_pred", "contaminated", "n_hit", "spans", "items", "n_words", "h", "_key", "n_tokens", "token_bytes", "decoded", "round_trip", "f0", "f1", "n", "s", "grams", "component_id", "id", "part", "tile", "label", "i", "v", "bundle")


def test_clashing_names(spark):
    """Columns of the documents that are called like those of results stay as they are."""
    rows = [(1, "le la les des une"), (2, None), (2, "seul " * 12), (None, "der die das und")]
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("fr")).withColumns({c: F.lit(c) for c in CLASHES})
    bench = spark.createDataFrame([(7, "seul " * 10), (8, "les des")], "item_id long, text string")
    for out in (
        langid.identify(clash, clash, carry=clash.columns),
        decontaminate.contamination(clash, bench, carry=clash.columns),
        decontaminate.contamination(clash, bench, carry=clash.columns, pattern_bytes=8),
        bpe.encode_decode(clash, vocabulary(), carry=clash.columns),
        lines.drop_repeated_lines(clash),
    ):
        found = out.select("row.*")
        assert found.columns == clash.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, clash.collect()))
    assert langid.identify(clash, clash).count() == bpe.query(clash, vocabulary()).count() == 4
    assert decontaminate.query(clash, bench).where("contaminated").count() == 2
    assert simhash.query(clash).count() == suffixes.query(clash).count() == sharding.extendible_shards(clash).count() == 4


def test_stages_of_odd_tables(spark):
    """Each stage on an empty table, and on nulls, repeats, and columns that are called like those of results."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    rows = [(1, "le la les des une", "fr", "s", 17), (1, "le la les des une", "fr", "s", 17), (2, None, None, None, None), (None, "der die das und", "de", None, 15), (3, "", "fr", "s", 0), (4, "mot " * 50_000, "fr", "s", 200_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in CLASHES})
    for name, stage in pipeline.STAGES:
        empty = stage(spark, odd.where("false"), sf)
        assert empty.count() == 0
        out = stage(spark, odd, sf)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns == empty.columns
            assert {r.id for r in out.collect()} == {"id"}


def test_language_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "le la les", "fr"), (1, "le la les", "fr"), (2, "der die das", "de"), (3, "le la " * 60_000, "fr")], "doc_id long, text string, lang string")
    out = langid.identify(df, df).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in out) == [(1, "fr"), (1, "fr"), (2, "de"), (3, "fr")]
    assert langid.query(df.where("false")).count() == 0


def test_more_empty_tables(spark):
    bench = spark.createDataFrame([(7, "seul")], "item_id long, text string")
    none = docs(spark, [])
    assert decontaminate.query(none, bench).count() == decontaminate.contamination(none, bench, pattern_bytes=2).count() == bpe.query(none, vocabulary()).count() == 0


def brute_contamination(texts, items, window=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    pats = {}
    for i, t in items:
        w = find(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            pats.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, own = find(t), set(), set()
        for k in range(len(w)):
            for n in {len(p) for p in pats}:
                if tuple(w[k : k + n]) in pats and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    own |= pats[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(map(str, own))))
    return out


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 40])
def test_contamination(spark, pattern_bytes):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["un", "Deux", "trois", "é", "x1"]) for _ in range(n))
    items = [(2, text(14)), (10, text(10)), (3, "court é"), (4, "seul"), (5, None), (6, "--"), (7, None)]
    items.append((8, items[0][1]))
    texts = [t for _, t in ODD] + [text(5) + ", " + items[0][1].upper() + "; " + text(40), "SEUL! court-é", text(60), items[1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, list(enumerate(texts))), bench, pattern_bytes=pattern_bytes).collect()}
    for i, (n, hit, own) in enumerate(brute_contamination(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (n, hit, own, hit > 0)
    assert decontaminate.contamination(docs(spark, texts and [(1, "a")]), bench.where("false")).first().n_hit == 0
    again = decontaminate.contamination(docs(spark, [(1, "seul"), (1, "seul"), (None, "seul")]), bench, pattern_bytes=pattern_bytes)
    assert again.where("contaminated").count() == 3


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 10])
def test_items_without_id(spark, pattern_bytes):
    """Items with a null id are found; their hits count, and they are not listed."""
    bench = spark.createDataFrame([(None, "eins zwei drei"), (None, "vier"), (7, "vier"), (8, "acht")], "item_id long, text string")
    texts = ["x Eins zwei, drei y", "vier", "eins zwei", "vier eins zwei drei acht"]
    out = decontaminate.contamination(docs(spark, list(enumerate(texts))), bench, pattern_bytes=pattern_bytes)
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in out.collect()}
    assert got == {0: (3, [], True), 1: (1, ["7"], True), 2: (0, [], False), 3: (5, ["7", "8"], True)}


def test_language(spark):
    rng = random.Random(7)
    make = {"fr": "le la les des une pour dans avec être été où", "de": "der die das und nicht für über mit ein schön", "es": "el los las una para con señor niño que muy"}
    rows = [(i, " ".join(rng.choice(make[k].split()) for _ in range(40)), k) for i, k in enumerate(rng.choice(list(make)) for _ in range(200))]
    df = spark.createDataFrame([*rows, (900, None, "fr"), (901, "123 -- !", "fr"), (902, "", None), (None, "le la des", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.query(df).collect()}
    import zlib

    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == k for i, k in held) == len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "fr" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    untaught = langid.identify(df, df.where("false")).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def brute_lines(texts):
    """Kept texts and longest repeats by looking at every run of lines in order of document and line."""
    split = [[s for s in (t or "").split("\n") if s.strip(" \t\r")] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, ls in enumerate(split):
        for j in range(len(ls)):
            for n in (1, 2):
                w = tuple(ls[j : j + n])
                if len(w) < n or n == 1 and len(ls[j].split()) < lines.MIN_WORDS:
                    continue
                if w in seen:
                    gone[d] |= set(range(j, j + n))
                seen.add(w)
    kept = []
    for d, t in enumerate(texts):
        j, left = -1, []
        for s in (t or "").split("\n"):
            j += bool(s.strip(" \t\r"))
            if j not in gone[d] or j < 0:
                left.append(s)
        kept.append("\n".join(left))
    longest, n = [0] * len(texts), 1
    while True:
        count = {}
        for ls in split:
            for j in range(len(ls) - n + 1):
                w = tuple(ls[j : j + n])
                count[w] = count.get(w, 0) + 1
        again = [any(count[tuple(ls[j : j + n])] > 1 for j in range(len(ls) - n + 1)) for ls in split]
        if not any(again):
            return kept, longest
        longest = [n if a else m for a, m in zip(again, longest)]
        n += 1


PARAGRAPH = " ".join(f"w{i}" for i in range(50))
SHORTER = " ".join(f"w{i}" for i in range(49)) + "x" * 80


@pytest.mark.parametrize("seed", [8, 9])
def test_lines(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "", " ", "c d", "é", PARAGRAPH, SHORTER]
    texts = [t for _, t in ODD] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["a\na\na\na", "l\n" * 70]
    texts += [f"p\n{PARAGRAPH}\nq", f"r\n{PARAGRAPH}\ns", f"t\n{SHORTER}\nu"] + ["\n".join(f"row {i}" for i in range(37)) + f"\n{k}" for k in "xyz"] + ["\n".join(f"row {i}" for i in range(5, 34))]
    out = lines.drop_repeated_lines(docs(spark, list(enumerate(texts)))).collect()
    got = {r["row"].doc_id: (r.kept or "", r.longest) for r in out}
    assert [got[i] for i in range(len(texts))] == list(zip(*brute_lines(texts)))
    assert lines.query(docs(spark, [])).count() == 0


def test_lines_of_repeated_rows(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "a\nb"), (None, "a\nb")]
    clash = docs(spark, rows).withColumns({c: F.lit("x") for c in ("d", "t", "kept", "longest", "runs", "n_lines", "row", "_kept", "m")})
    out = lines.drop_repeated_lines(clash).collect()
    assert sorted((r["row"].doc_id or 99, r.kept) for r in out) == [(1, "a\nb"), (1, "a\nb"), (2, ""), (99, "")]
    assert {(r["row"].d, r["row"]["row"], r.longest) for r in out} == {("x", "x", 2)}


def test_bpe(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    pool = "abcdeé ñ東京\n\t 0123 '’sS😀<|>.,-  ‍́ß"
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a" * 5000, "<|endoftext|><|endoftext|> a<|endoftext|"]
    reference = Tokenizer.from_file(vocabulary())
    want = reference.encode_batch(texts, add_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_decode(docs(spark, list(enumerate(texts))), vocabulary()).collect()}
    for i, e in enumerate(want):
        assert np.frombuffer(bytes(got[i].token_bytes), "<u4").tolist() == e.ids, repr(texts[i])
        assert got[i].decoded == reference.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs(spark, ODD), vocabulary()).count() == len(ODD)


def test_topk(spark):
    rng = np.random.default_rng(10)
    v = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 200, 0), rng.normal(size=(100, 8)) * 0.01]).round(3)
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1051, [float("nan")] * 8), (1052, []), (1150, []), (1153, []), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (5, [float(np.float32(x)) for x in v[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, query_rows=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = np.floor(256 * v.astype(np.float32).astype(float)).astype(int)
    for i in range(0, len(v), 50):
        s = q @ q[i]
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], j))[:5]
        assert sorted(got[i]) == [(k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert got[1150] == [(1, 1052, 0), (2, 1153, 0)]
    clash = df.withColumns({c: F.lit("x") for c in ("rank", "score", "query_id", "_id", "_v")})
    assert topk.query(clash).count() == topk.query(df).count() == sum(map(len, got.values()))
    assert got[1100] == [(1, 1101, 256 * 256 * 4)] and 1000 not in got and 1050 not in got
    assert topk.query(df.where("false")).count() == 0


def test_cover_tree():
    """Nesting, covering and separation hold, and most pairs are skipped where the data are clustered."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 4)) * 1000
    points = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(2000, 4)))
    tree = topk.CoverTree(points)
    assert sorted(i for n, kids in enumerate(tree.children) if not kids for i in tree.rows[n].tolist()) == list(range(2000))
    for n, kids in enumerate(tree.children):
        assert (np.linalg.norm(points[tree.rows[n]] - tree.centre[n], axis=1) <= tree.radius[n] + 1e-6).all()
        assert sorted(i for k in kids for i in tree.rows[k].tolist()) == (sorted(tree.rows[n].tolist()) if kids else [])
    best = topk.Best(np.arange(0, 2000, 2), 5)
    work = topk.dual_search(topk.CoverTree(points[::2]), best, tree, [np.array([i]) for i in range(2000)])
    assert work < 0.3 * 1000 * 2000


@pytest.mark.parametrize("limit", [30, 200, 100_000])
def test_sharding(spark, limit):
    rng = random.Random(12)
    rows = [(i, "x" * rng.randint(0, 30)) for i in range(150)] + [(900, "big" * 40), (None, None), (5, "")] + [(7, "same text")] * 60
    out = sharding.extendible_shards(docs(spark, rows), limit_bytes=limit, first_bits=4, step_bits=8).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in out) == sorted((i or -1, len(t or "")) for i, t in rows)
    total, member = {}, {}
    for r in out:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
        member.setdefault(r.shard, []).append(r)
    for s, n in total.items():
        assert n == member[s][0].shard_bytes and (n <= limit or len(member[s]) == 1)
        plain = s.split("#")[0]
        assert len(plain) == member[s][0].depth
    # a bucket is split only if it is too large: a parent's bytes exceed the limit
    for s in {x.split("#")[0] for x in total}:
        if s:
            assert sum(n for x, n in total.items() if x.split("#")[0].startswith(s[:-1])) > limit
    assert sharding.extendible_shards(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [100, 5_000, 200_000])
def test_sharding_by_sql(spark, limit):
    import duckdb

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(7, "same text " * 3)] * 90 + [(None, None), (5, ""), (5, "")], "doc_id long, text string")
    rows = table.unionByName(extra)
    documents = rows.toPandas()  # noqa: F841
    want = duckdb.sql(sharding.oracle(limit).replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, text FROM documents)")).fetchall()
    got = sharding.extendible_shards(rows, limit_bytes=limit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    frame, frames = table, []
    scratch = Scratch(spark, "t")
    for _, stage in pipeline.STAGES:
        frame = scratch.write(stage(spark, frame, sf))
        frames.append(frame.toPandas())
    assert all(list(f.columns) == table.columns for f in frames[:-1])
    texts = lambda f: list(f.sort_values("doc_id").text)
    before = table.toPandas()
    assert sorted(frames[0].doc_id) == sorted(before.doc_id)  # every document has letters
    kept = brute_lines(texts(frames[0]))[0]
    assert texts(frames[1]) == [t for t, old in zip(kept, texts(frames[0])) if t or t == old]
    grams = lambda t: set(simhash.shingles(t, 5))
    left, gone = frames[2], set(frames[1].doc_id) - set(frames[2].doc_id)
    by_id = dict(zip(frames[1].doc_id, frames[1].text))
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = {i: grams(t) for i, t in by_id.items()}
    for i in gone:  # each is similar to another document
        assert any(j != i and near(sets[i], sets[j]) for j in sets)
    stay = list(left.doc_id)
    assert not any(near(sets[i], sets[j]) for n, i in enumerate(stay) for j in stay[:n])
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    hits = brute_contamination(list(left.text), list(zip(items.item_id, items.text)))
    assert set(frames[3].doc_id) == {i for i, h in zip(left.doc_id, hits) if not h[1]}
    assert frames[4].round_trip.all() and set(frames[4].doc_id) == set(frames[3].doc_id)
    assert set(frames[4].doc_id) == {r.doc_id for r in pipeline.run(spark, sf).select("doc_id").collect()}
