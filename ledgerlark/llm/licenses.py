"""Operator 4: licence recognition by sentence rules, with DataFrame functions only.

Sentences are normalised and looked up among known licence sentences; the sequence of identifiers
found in a document is matched against rules, each an ordered run of identifiers. Everything is an
expression over one row, so the plan has no exchange at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of public licences and notices, normalised (lower case, runs of other characters as one space). Fixed values.
SENTENCES: dict[int, str] = {
    1: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    2: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    3: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    4: "released under the mit license",
    5: "licensed under the mit license",
    6: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at",
    14: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    15: "see the license for the specific language governing permissions and limitations under the license",
    16: "apache license version 2 0 january 2004",
    17: "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    18: "you must give any other recipients of the work or derivative works a copy of this license",
    19: "unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    23: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    24: "see the gnu general public license for more details",
    25: "the gnu general public license is a free copyleft license for software and other kinds of works",
    26: "the licenses for most software are designed to take away your freedom to share and change it",
    27: "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    29: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    30: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    31: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    32: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    33: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    34: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    35: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    44: "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    50: "all rights reserved",
    60: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    61: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    62: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    63: "see the gnu lesser general public license for more details",
    64: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    65: "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    66: "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    70: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    71: "see the gnu affero general public license for more details",
    72: "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    80: "this source code form is subject to the terms of the mozilla public license v",
    81: "if a copy of the mpl was not distributed with this file you can obtain one at",
    82: "mozilla public license version 2 0",
    83: "each contributor hereby grants you a world wide royalty free non exclusive license",
    85: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    90: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    91: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    92: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    100: "this is free and unencumbered software released into the public domain",
    101: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    110: "this software is provided as is without any express or implied warranty",
    111: "in no event will the authors be held liable for any damages arising from the use of this software",
    112: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    113: "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    114: "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    115: "this notice may not be removed or altered from any source distribution",
    120: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    121: "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    122: "distributed under the boost software license version 1 0",
    130: "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
    131: "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work under this license whichever comes first the licensor hereby grants you rights under the terms of the change license and the rights granted in the paragraph above terminate",
}

#: Licence rules: (rule, licence, identifiers in order). Fixed values.
RULES: list[tuple[str, str, tuple[int, ...]]] = [
    ("mit-text", "MIT", (1, 2, 3)),
    ("mit-released", "MIT", (4,)),
    ("mit-licensed", "MIT", (5,)),
    ("apache-notice", "Apache-2.0", (10,)),
    ("apache-header", "Apache-2.0", (11, 12, 13)),
    ("apache-header-full", "Apache-2.0", (11, 12, 13, 14, 15)),
    ("apache-text", "Apache-2.0", (16, 17, 18, 19)),
    ("gpl3-notice", "GPL-3.0", (20,)),
    ("gpl3-header", "GPL-3.0-or-later", (21, 23, 24)),
    ("gpl2-header", "GPL-2.0-or-later", (22, 23, 24)),
    ("gpl2-only-header", "GPL-2.0-only", (28, 23, 24)),
    ("gpl3-only-header", "GPL-3.0-only", (29, 23, 24)),
    ("gpl3-text", "GPL-3.0", (25,)),
    ("gpl2-text", "GPL-2.0", (26, 27)),
    ("bsd2-text", "BSD-2-Clause", (30, 31, 32)),
    ("bsd3-text", "BSD-3-Clause", (30, 31, 32, 33)),
    ("bsd4-text", "BSD-4-Clause", (30, 31, 32, 35)),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", (40,)),
    ("cc-by-notice", "CC-BY-4.0", (41,)),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", (42,)),
    ("cc-by-text", "CC-BY-4.0", (43,)),
    ("cc0-waiver", "CC0-1.0", (44,)),
    ("all-rights-reserved", "Proprietary", (50,)),
    ("lgpl21-header", "LGPL-2.1-or-later", (60, 62, 63)),
    ("lgpl3-header", "LGPL-3.0-or-later", (61, 62, 63)),
    ("lgpl3-program-header", "LGPL-3.0-or-later", (64, 23, 63)),
    ("lgpl3-text", "LGPL-3.0", (65,)),
    ("lgpl21-text", "LGPL-2.1", (26, 66)),
    ("agpl3-header", "AGPL-3.0-or-later", (70, 23, 71)),
    ("agpl3-text", "AGPL-3.0", (72,)),
    ("mpl2-header", "MPL-2.0", (80, 81)),
    ("mpl2-text", "MPL-2.0", (82, 83)),
    ("epl2-notice", "EPL-2.0", (85,)),
    ("isc-text", "ISC", (90, 91)),
    ("0bsd-text", "0BSD", (92, 91)),
    ("unlicense-text", "Unlicense", (100, 101)),
    ("zlib-text", "Zlib", (110, 111, 112, 113, 114, 115)),
    ("boost-text", "BSL-1.0", (120, 121)),
    ("boost-notice", "BSL-1.0", (122,)),
    ("busl-text", "BUSL-1.1", (130, 131)),
]

#: Identifiers of the SPDX list that are recognised in "SPDX-License-Identifier:" lines. Fixed values.
SPDX = """MIT MIT-0 Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0
BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib Unlicense BSL-1.0 BUSL-1.1 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0""".split()
SENTENCES |= {1000 + n: "spdx license identifier " + " ".join(x.lower().replace("-", " ").replace(".", " ").split()) for n, x in enumerate(SPDX)}
RULES += [(f"spdx-{x.lower()}", x, (1000 + n,)) for n, x in enumerate(SPDX)]

#: A known sentence of so many words is recognised wherever it stands in a paragraph; a shorter one must be a whole sentence or line.
LONG_WORDS = 9
#: Marks in a normalised text: what ends a sentence, a line, a paragraph, and what begins the next.
_SENTENCE, _LINE, _PARAGRAPH, _BEGIN = "\x01", "\x02", "\x03", "\x04"


def cue_words(sentences: dict[int, str]) -> list[str]:
    """Few words such that every known sentence has one: greedy by the number of sentences reached."""
    left, cues = dict(sentences), []
    while left:
        words = sorted({w for s in left.values() for w in s.split()}, key=lambda w: (-sum(w in s.split() for s in left.values()), -len(w), w))
        cues.append(next(w for w in words if len(w) >= 6 or w == words[-1]))
        left = {i: s for i, s in left.items() if cues[-1] not in s.split()}
    return cues


#: The steps that normalise a text that is lower-cased, has no marks and ends with a line break: pattern, replacement.
_STEPS = [
    ("[.!?]+([ \\t\\r\\n])", _SENTENCE + "{1}"),  # a sentence ends
    ("\\n", _LINE),
    (f"[^a-z0-9{_SENTENCE}{_LINE}]+", " "),
    (f" *([{_SENTENCE}{_LINE}]) *", "{1}"),
    (f"{_LINE}{_LINE}+", _PARAGRAPH),
    (f"{_SENTENCE}+([{_LINE}{_PARAGRAPH}])", "{1}" + _SENTENCE),
    (f"{_PARAGRAPH}{_SENTENCE}", _PARAGRAPH),
    (f"{_LINE}{_SENTENCE}", _SENTENCE),  # a sentence that ends with its line
    (f"([{_SENTENCE}{_LINE}{_PARAGRAPH}])", "{1}" + _BEGIN),
    (" *([a-z0-9]+) *", " {1} "),  # each word with its own blanks, so that neighbours share none
]


def _pattern(sentences: dict[int, str]) -> str:
    """What matches any known sentence in a normalised text; of those that begin at one place the longest."""
    between = f" (?:{_LINE}{_BEGIN})? "
    one = []
    for s in sorted(sentences.values(), key=lambda s: (-len(s.split()), s)):
        words = " " + between.join(s.split()) + " "
        one.append(words if len(s.split()) >= LONG_WORDS else f"{_BEGIN}{words}[{_SENTENCE}{_LINE}{_PARAGRAPH}]")
    return "|".join(one)


def sentence_ids(text: Column, sentences: dict[int, str]) -> Column:
    """Identifiers of the known sentences of a text, in text order.

    A sentence ends at one of . ! ? followed by white space or at a line break, and may be wrapped over
    lines, with comment signs around them; blank lines (also of comment signs only) end it for good.
    Known sentences of LONG_WORDS words may have others before and after them, as in a licence text on
    one line; shorter ones must be whole sentences or lines. Unknown sentences are skipped. Only texts
    with a cue word are searched; a text without any holds no known sentence.
    """
    lowered = F.lower(text)
    normal = F.concat(F.translate(lowered, _SENTENCE + _LINE + _PARAGRAPH + _BEGIN, "    "), F.lit("\n"))
    for pattern, instead in _STEPS:
        normal = F.regexp_replace(normal, pattern, instead.replace("{1}", "$1"))
    known = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)])
    hits = F.regexp_extract_all(F.concat(F.lit(_BEGIN), normal), F.lit(f"({_pattern(sentences)})"), F.lit(1))
    plain = lambda h: F.trim(F.regexp_replace(h, "[^a-z0-9]+", " "))
    found = F.transform(hits, lambda h: F.try_element_at(known, plain(h)))
    empty = F.array().cast("array<int>")
    return F.when(lowered.rlike("|".join(cue_words(sentences))), found).otherwise(empty)


def _within(short: tuple[int, ...], long_: tuple[int, ...]) -> bool:
    """Whether a rule's identifiers are a part of a longer rule's."""
    return len(short) < len(long_) and any(long_[k : k + len(short)] == short for k in range(len(long_)))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """Each document's known licence sentences and the rules they satisfy: key, sentence_ids, rules, licenses.

    A rule holds where its identifiers follow one another in the document's identifier sequence
    (sentences that are not known may stand between); one that is a part of a longer rule that holds
    as well is left out. Null and empty texts have none. Every row gives one row; repeated rows repeat;
    rules that hold at once are all reported, in rule order. Empty tables give no rows; other columns
    may have any names.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    ids = sentence_ids(F.col(text), sentences)
    base = docs.select(F.col(key).alias(key), F.coalesce(ids, F.array().cast("array<int>")).alias("sentence_ids"))
    sequence = F.concat(F.lit(","), F.array_join(F.transform("sentence_ids", lambda i: i.cast("string")), ","), F.lit(","))
    # texts without known sentences go no further
    held = lambda seq: F.contains(sequence, F.lit("," + ",".join(map(str, seq)) + ","))
    names = F.array_compact(F.array(*[F.when(held(seq), F.lit(rule)) for rule, _, seq in rules]))
    longer = {rule: [r for r, _, q in rules if _within(seq, q)] for rule, _, seq in rules}
    shadows = [(rule, over) for rule, over in longer.items() if over]
    base = base.withColumn("_held", F.when(F.size("sentence_ids") > 0, names).otherwise(F.array().cast("array<string>")))
    shadowed = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.arrays_overlap("_held", F.array(*map(F.lit, over))), F.lit(rule)) for rule, over in shadows]))
    base = base.withColumn("_held", F.when(F.size("_held") > 1, F.array_except("_held", shadowed)).otherwise(F.col("_held")))
    licence = F.create_map(*[F.lit(x) for rule, name, _ in rules for x in (rule, name)])
    names = F.array_sort(F.array_distinct(F.transform("_held", lambda r: F.element_at(licence, r))))
    return base.select(key, "sentence_ids", F.col("_held").alias("rules"), names.alias("licenses"))


def query(docs: DataFrame) -> DataFrame:
    """Flat columns for the registered query."""
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    out = license_scan(docs)
    return out.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), join("sentence_ids").alias("sentence_ids"), join("rules").alias("rules"), join("licenses").alias("licenses"))


def oracle() -> str:
    """The same result in DuckDB's SQL, from the same tables of sentences and rules."""
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"({n}, '{r}', '{x}', ',{','.join(map(str, q))},')" for n, (r, x, q) in enumerate(RULES))
    over = ", ".join(f"('{a}', '{b}')" for a, _, p in RULES for b, _, q in RULES if _within(p, q))
    normal = f"translate(lower(text), {literal(_SENTENCE + _LINE + _PARAGRAPH + _BEGIN)}, '    ') || chr(10)"
    for pattern, instead in _STEPS:
        normal = f"regexp_replace({normal}, {literal(pattern)}, {literal(instead.replace('{1}', chr(92) + '1'))}, 'g')"
    return f"""
WITH known(id, s) AS (VALUES {known}), rules(n, rule, licence, seq) AS (VALUES {rules}), longer(rule, other) AS (VALUES {over}),
hits AS (SELECT doc_id, regexp_extract_all({literal(_BEGIN)} || {normal}, {literal(_pattern(SENTENCES))}) AS h FROM documents),
parts AS (SELECT doc_id, unnest(h) AS p, generate_subscripts(h, 1) AS pos FROM hits),
found AS (SELECT doc_id, pos, id FROM parts JOIN known ON s = trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))),
seqs AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id::VARCHAR, ',' ORDER BY pos) AS sentence_ids FROM found GROUP BY doc_id),
every AS (SELECT doc_id, n, rule, licence FROM seqs JOIN rules ON contains(',' || sentence_ids || ',', seq)),
held AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM longer JOIN every o ON o.rule = longer.other WHERE longer.rule = e.rule AND o.doc_id = e.doc_id)),
named AS (SELECT doc_id, string_agg(rule, ',' ORDER BY n) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses FROM held GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN seqs USING (doc_id) LEFT JOIN named USING (doc_id)"""
