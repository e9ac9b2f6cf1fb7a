"""Operator 3, licence scans by sentence rules. DataFrame functions only.

Texts are cut into sentences; a sentence is normalised (A-Z lower-cased, other runs than letters, digits and non-ASCII to
one space, which takes comment marks and list signs away) and mapped to the identifier of a known licence sentence. Each
line's part is tried by itself, and the parts of a sentence that is wrapped over lines as one: from each line on from which
to the sentence's end there are as many words as a known sentence has, as a line without a full stop may stand right before
it. A notice (``open``) is also found where more words follow it in its sentence. Names behind an SPDX marker count on the
marker's own line: all of an expression with OR and AND, not the exception behind WITH. The identifiers found in a text, in its
order, form a sequence; a licence rule is an ordered list of identifiers, which the sequence must contain in that order, with
other known sentences allowed between. A rule's identifiers are taken before those of rules that are a part of it, which
then need identifiers of their own; rules of WEAK kinds hold only where no other does.

Texts that lack all of a few words, of which every known sentence has one, aren't cut at all.

Both tables are bounded (checked), so they are literals in one expression over a row: no shuffle, and rows that share a
doc_id never mix.

Defined results: a null or empty text has one empty sentence and no licence; every row gets a row of its own, whatever its
doc_id; a sentence counts as often as it stands in the text; a text may match several licences; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licences and notices, as their texts have them (identifier, sentence, may more follow).
SENTENCES = [
    (1, "Released under the MIT License", True),
    (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", False),
    (3, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", False),
    (4, "Licensed under the Apache License, Version 2.0", True),
    (5, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", False),
    (6, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", False),
    (7, "This work is licensed under the GNU General Public License, version 3", True),
    (8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", False),
    (9, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", False),
    (10, "Licensed under CC BY-NC 4.0", True),
    (11, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", False),
    (12, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", False),
    (13, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", False),
    (14, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", False),
    (15, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", False),
    (16, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", False),
    (17, "This is free and unencumbered software released into the public domain.", False),
    (18, "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", False),
    (19, "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", False),
    (20, "This project is licensed under the MIT License", True),
    (21, "Licensed under the MIT License", True),
    (22, "Distributed under the MIT License", True),
    (23, "You may obtain a copy of the License at", True),
    (24, "See the License for the specific language governing permissions and limitations under the License.", False),
    (25, "This project is licensed under the Apache License, Version 2.0", True),
    (26, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", False),
    (27, "You should have received a copy of the GNU General Public License along with this program.", False),
    (28, "See the GNU General Public License for more details.", False),
    (29, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", False),
    (30, "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", False),
    (31, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", False),
    (32, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", False),
    (33, "If a copy of the MPL was not distributed with this file, You can obtain one at", True),
    (34, "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", False),
    (35, "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", False),
    (36, "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", False),
    (37, "This software is provided 'as-is', without any express or implied warranty.", False),
    (38, "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", False),
    (39, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", False),
    (40, "Distributed under the Boost Software License, Version 1.0", True),
    (41, "This work is licensed under a Creative Commons Attribution 4.0 International License.", False),
    (42, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", False),
    (43, "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", False),
    (44, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", False),
    (45, "Licensed under CC BY 4.0", True),
    (46, "Licensed under CC BY-SA 4.0", True),
    (47, "Licensed under CC BY-NC-SA 4.0", True),
    (48, "Licensed under CC BY-ND 4.0", True),
    (49, "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", False),
    (50, "SPDX-License-Identifier:", False),
    (64, "All rights reserved.", True),
]
# Names of licences behind the SPDX marker (identifier, name), those of the short form in the last lines.
NAMES = [
    (51, "MIT"),
    (52, "Apache-2.0"),
    (53, "GPL-2.0-only"),
    (54, "GPL-2.0-or-later"),
    (55, "GPL-3.0-only"),
    (56, "GPL-3.0-or-later"),
    (57, "BSD-2-Clause"),
    (58, "BSD-3-Clause"),
    (59, "MPL-2.0"),
    (60, "CC0-1.0"),
    (61, "ISC"),
    (62, "LGPL-2.1-or-later"),
    (63, "AGPL-3.0-or-later"),
    (65, "Zlib"),
    (66, "BSL-1.0"),
    (67, "Unlicense"),
    (68, "CC-BY-4.0"),
    (69, "CC-BY-SA-4.0"),
    (53, "GPL-2.0"),
    (54, "GPL-2.0+"),
    (55, "GPL-3.0"),
    (56, "GPL-3.0+"),
    (62, "LGPL-2.1+"),
    (63, "AGPL-3.0+"),
]
# Fixed values: (rule, licence, kind, identifiers in order).
RULES = [
    ("mit-notice", "MIT", "permissive", [1]),
    ("mit-text", "MIT", "permissive", [2, 3]),
    ("mit-text-whole", "MIT", "permissive", [2, 3, 18, 19]),
    ("mit-project", "MIT", "permissive", [20]),
    ("mit-licensed", "MIT", "permissive", [21]),
    ("mit-distributed", "MIT", "permissive", [22]),
    ("mit-spdx", "MIT", "permissive", [50, 51]),
    ("apache-notice", "Apache-2.0", "permissive", [4]),
    ("apache-header", "Apache-2.0", "permissive", [5, 6]),
    ("apache-header-whole", "Apache-2.0", "permissive", [5, 23, 6, 24]),
    ("apache-project", "Apache-2.0", "permissive", [25]),
    ("apache-spdx", "Apache-2.0", "permissive", [50, 52]),
    ("gpl3-notice", "GPL-3.0-only", "copyleft", [7]),
    ("gpl3-header", "GPL-3.0-or-later", "copyleft", [8, 9]),
    ("gpl3-header-whole", "GPL-3.0-or-later", "copyleft", [8, 9, 28, 27]),
    ("gpl3-spdx", "GPL-3.0-only", "copyleft", [50, 55]),
    ("gpl3-later-spdx", "GPL-3.0-or-later", "copyleft", [50, 56]),
    ("gpl2-header", "GPL-2.0-or-later", "copyleft", [26, 9]),
    ("gpl2-spdx", "GPL-2.0-only", "copyleft", [50, 53]),
    ("gpl2-later-spdx", "GPL-2.0-or-later", "copyleft", [50, 54]),
    ("lgpl21-header", "LGPL-2.1-or-later", "copyleft", [29, 30]),
    ("lgpl21-spdx", "LGPL-2.1-or-later", "copyleft", [50, 62]),
    ("agpl3-header", "AGPL-3.0-or-later", "copyleft", [31, 9]),
    ("agpl3-spdx", "AGPL-3.0-or-later", "copyleft", [50, 63]),
    ("mpl2-header", "MPL-2.0", "copyleft", [32, 33]),
    ("mpl2-spdx", "MPL-2.0", "copyleft", [50, 59]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "non-commercial", [10]),
    ("cc-by-nc-text", "CC-BY-NC-4.0", "non-commercial", [11]),
    ("cc-by-nc-sa-notice", "CC-BY-NC-SA-4.0", "non-commercial", [47]),
    ("cc-by-nc-sa-text", "CC-BY-NC-SA-4.0", "non-commercial", [43]),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", "no-derivatives", [48]),
    ("cc-by-nd-text", "CC-BY-ND-4.0", "no-derivatives", [44]),
    ("cc-by-notice", "CC-BY-4.0", "permissive", [45]),
    ("cc-by-text", "CC-BY-4.0", "permissive", [41]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "copyleft", [46]),
    ("cc-by-sa-text", "CC-BY-SA-4.0", "copyleft", [42]),
    ("cc0-text", "CC0-1.0", "public-domain", [49]),
    ("cc0-spdx", "CC0-1.0", "public-domain", [50, 60]),
    ("bsd2-text", "BSD-2-Clause", "permissive", [12, 13, 14]),
    ("bsd2-text-whole", "BSD-2-Clause", "permissive", [12, 13, 14, 34]),
    ("bsd3-text", "BSD-3-Clause", "permissive", [12, 13, 14, 15]),
    ("bsd3-text-whole", "BSD-3-Clause", "permissive", [12, 13, 14, 15, 34]),
    ("bsd2-spdx", "BSD-2-Clause", "permissive", [50, 57]),
    ("bsd3-spdx", "BSD-3-Clause", "permissive", [50, 58]),
    ("isc-text", "ISC", "permissive", [16]),
    ("isc-text-whole", "ISC", "permissive", [16, 35]),
    ("isc-spdx", "ISC", "permissive", [50, 61]),
    ("zlib-text", "Zlib", "permissive", [37, 38]),
    ("zlib-spdx", "Zlib", "permissive", [50, 65]),
    ("boost-spdx", "BSL-1.0", "permissive", [50, 66]),
    ("unlicense-spdx", "Unlicense", "public-domain", [50, 67]),
    ("cc-by-spdx", "CC-BY-4.0", "permissive", [50, 68]),
    ("cc-by-sa-spdx", "CC-BY-SA-4.0", "copyleft", [50, 69]),
    ("boost-notice", "BSL-1.0", "permissive", [40]),
    ("boost-text", "BSL-1.0", "permissive", [39]),
    ("unlicense-text", "Unlicense", "public-domain", [17]),
    ("unlicense-text-whole", "Unlicense", "public-domain", [17, 36]),
    ("reserved-notice", "proprietary", "all-rights-reserved", [64]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A part ends at a line end, or at . ! ? : before white space; its sentence goes on in the next part unless one of the two
#: is blank or it ends with . ! ? :
PART_END = r"[.!?:][ \t\r]|\n"
SENTENCE_END = r"[.!?:][ \t\r\n]*$"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: A caller's tables may have so many rows; they become literals of one expression.
MAX_SENTENCES, MAX_RULES = 20_000, 5_000
#: Kinds of rules that say nothing beside another licence.
WEAK = ("all-rights-reserved",)
#: A text is looked for so many words before it is cut; tables that need more do without.
MAX_GATE = 48
#: The marker's part, cut behind its colon; a name is looked up under this sign, which no sentence has.
MARKER, MARKER_END, NAME = "spdx license identifier", r":[ \t]$", "spdx:"
NAME_SPLIT, NO_NAME = r"[^a-z0-9.+-]+", ("", "or", "and")
FOUND = "array<struct<place:int,id:int>>"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), OTHER, " "))


def longest_part(sentence: Column) -> Column:
    """Of a known sentence with . ! ? : inside, which texts are cut at, the longest part; its identifier stands for it."""
    parts = F.transform(F.split(sentence, r"[.!?:]\s"), normalised)
    return F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))["s"]


def known_sentences(spark: SparkSession) -> DataFrame:
    """(sentence_id, sentence, open): ours; any table of this shape will do, with sentences as they are written."""
    return spark.createDataFrame(SENTENCES, "sentence_id int, sentence string, open boolean")


def rules(spark: SparkSession) -> DataFrame:
    """(rule, licence, kind, ids): ours; any table of this shape will do."""
    return spark.createDataFrame(RULES, "rule string, licence string, kind string, ids array<int>")


def _bounded(table: DataFrame, most: int, what: str) -> list:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return sorted(rows)


def gate_words(sentences: list[str]) -> list[str]:
    """A few words of which each sentence has one: again and again the one that most of the rest have. Of words, a sentence
    offers those of six letters or more, or else its longest, as short ones stand in all texts."""
    left, words = [], []
    for x in sentences:
        ws = set(x.split(" "))
        left.append({w for w in ws if len(w) >= min(6, max(map(len, ws)))})
    while left:
        counts: dict[str, int] = {}
        for ws in left:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
        words.append(min(counts, key=lambda w: (-counts[w], -len(w), w)))
        left = [ws for ws in left if words[-1] not in ws]
    return words


def parts_of(text: Column) -> Column:
    """Of each part of a text: its sentence normalised, how many words that has, whether a sentence ends with it, and itself."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), PART_END, "$0\x01")
    return F.transform(F.transform(F.split(marked, "\x01"), lambda x: F.struct(normalised(x).alias("sentence"), x.alias("raw"))), lambda x: F.struct(x["sentence"].alias("sentence"), F.when(x["sentence"] == "", 0).otherwise(F.size(F.split(x["sentence"], " "))).alias("n"), x["raw"].rlike(SENTENCE_END).alias("ends"), x["raw"].alias("raw")))


def candidates(p: Column, lengths: list[int], first_words: list[str], open_words: int) -> tuple[Column, Column]:
    """(place, sentence normalised) of parts (``parts_of``): those that a known sentence may be, and those that a notice may begin.

    ``lengths``: how many words known sentences have; ``first_words``, ``open_words``: how notices begin, and words of the longest."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    of = lambda i: F.get(p, i)
    apart = lambda i: of(i - 1)["ends"] | (of(i - 1)["n"] == 0) | (of(i)["n"] == 0)
    first = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | apart(i))
    said = lambda a, b: F.array_join(F.transform(F.slice(p, a + 1, b - a), lambda x: x["sentence"]), " ")
    ends = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(p))
    runs = let(first, lambda f: F.filter(F.transform(f, lambda a, k: F.struct(a.alias("a"), ends(f, k).alias("b"))), lambda z: z["b"] - z["a"] > 1))
    words = lambda a, b: F.aggregate(F.slice(p, a + 1, b - a), F.lit(0), lambda n, x: n + x["n"])
    # Each line of a run has a word at least.
    near = lambda z: F.sequence(F.greatest(z["a"], z["b"] - max(lengths)), z["b"] - 2)
    starts = lambda z: F.filter(near(z), lambda i: words(i, z["b"]).isin(lengths))
    wrapped = F.flatten(F.transform(runs, lambda z: F.transform(F.when(z["b"] - max(lengths) <= z["b"] - 2, starts(z)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("place"), said(i, z["b"]).alias("sentence")))))
    alone = F.transform(p, lambda x, i: F.struct(i.alias("place"), x["sentence"].alias("sentence")))
    # Names behind a marker on its line; what stands behind WITH is an exception.
    marked = lambda i: (i > 0) & (of(i - 1)["sentence"] == MARKER) & of(i - 1)["raw"].rlike(MARKER_END)
    tokens = lambda x: F.filter(F.split(F.translate(x["raw"], UPPER, LOWER), NAME_SPLIT), lambda t: ~t.isin(*NO_NAME))
    names = lambda ts, i: F.transform(F.filter(ts, lambda t, j: (t != "with") & ((j == 0) | (F.get(ts, j - 1) != "with"))), lambda t: F.struct(i.alias("place"), F.concat(F.lit(NAME), t).alias("sentence")))
    named = F.flatten(F.transform(p, lambda x, i: F.when(F.coalesce(marked(i), F.lit(False)), let(tokens(x), lambda ts: names(ts, i))).otherwise(F.array().cast("array<struct<place:int,sentence:string>>"))))
    begins = lambda i: F.substring_index(of(i)["sentence"], " ", 1).isin(first_words)
    opening = lambda z: F.transform(F.filter(F.sequence(z["a"], z["b"] - 2), begins), lambda i: F.struct(i.alias("place"), said(i, F.least(z["b"], i + open_words + 1)).alias("sentence")))
    openings = F.concat(alone, F.flatten(F.transform(runs, opening))) if first_words else F.array().cast("array<struct<place:int,sentence:string>>")
    return F.concat(F.filter(F.concat(alone, wrapped), lambda x: x["sentence"] != ""), named), openings


def sentence_ids(text: Column, sentences: list) -> Column:
    """The identifiers of a text's known sentences, in its order. sentences: rows (sentence_id, sentence normalised, open)."""
    nothing = F.array().cast("array<int>")
    if not sentences:
        return F.transform(F.array().cast(FOUND), lambda x: x["id"])
    exact: dict[str, list[int]] = {}
    for i, s, _ in sentences:
        exact.setdefault(s, []).append(i)
    notices: dict[int, dict[str, list[int]]] = {}
    for i, s, more in sentences:
        if more:
            notices.setdefault(len(s), {}).setdefault(s, []).append(i)
    plain = [s for s in exact if not s.startswith(NAME)]
    opens = [s for _, s, more in sentences if more]
    lengths = sorted({len(s.split(" ")) for s in plain} or {0})

    def of(place: Column, sentence: Column, known: dict[str, list[int]]) -> Column:
        # Most sentences are known to no one: a hash lookup sets them aside before the map is searched.
        ids = F.create_map(*[F.lit(x) for s, i in sorted(known.items()) for x in (s, F.lit(",".join(map(str, i))))])
        each = F.transform(F.split(ids[sentence], ","), lambda i: F.struct(place.alias("place"), i.cast("int").alias("id")))
        return F.when(sentence.isin(sorted(known)), each).otherwise(F.array().cast(FOUND))

    def begun(x: Column) -> Column:
        hits = [F.when(F.substring(x["sentence"], n + 1, 1) == " ", of(x["place"], F.left(x["sentence"], F.lit(n)), known)).otherwise(F.array().cast(FOUND)) for n, known in sorted(notices.items())]
        return F.concat(*hits)

    def found(p: Column) -> Column:
        whole, openings = candidates(p, lengths, sorted({s.split(" ")[0] for s in opens}), max((len(s.split(" ")) for s in opens), default=0))
        hits = F.flatten(F.transform(whole, lambda x: of(x["place"], x["sentence"], exact)))
        if opens:
            hits = F.concat(hits, F.flatten(F.transform(openings, begun)))
        return F.transform(F.array_sort(F.array_distinct(hits)), lambda x: x["id"])

    ids = F.get(F.transform(F.array(parts_of(text)), found), F.lit(0))
    gate = gate_words([*plain, *([MARKER] if len(plain) < len(exact) else [])])
    if len(gate) > MAX_GATE:
        return ids
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    open_gate = F.get(F.transform(F.array(lower), lambda t: F.greatest(*[F.contains(t, F.lit(w)) for w in gate], F.lit(False))), F.lit(0))
    return F.when(open_gate, ids).otherwise(nothing)


def is_part(short: list[int], long: list[int]) -> bool:
    """Whether one list is in another, in its order, and shorter."""
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def taken_before(rows: list) -> list[tuple]:
    """(rule, the longer rules that it is a part of, longest first) of each of some rules."""
    return [(r, sorted((x for x in rows if is_part(r["ids"], x["ids"])), key=lambda x: (-len(x["ids"]), x["rule"]))) for r in rows]


def scan(docs: DataFrame, sentences: DataFrame | None = None, rule_table: DataFrame | None = None, names: list[tuple[int, str]] | None = None, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """``docs`` (text and others) with licence_ids, licences, licence_kinds and licence_rules: arrays, all but the first sorted."""
    spark = docs.sparkSession
    table = known_sentences(spark) if sentences is None else sentences
    known = _bounded(table.select("sentence_id", longest_part(F.col("sentence")).alias("s"), "open").where("s <> ''"), MAX_SENTENCES, "sentences")
    known = [*known, *((i, NAME + n.lower(), False) for i, n in (NAMES if names is None else names))]
    rows = _bounded((rules(spark) if rule_table is None else rule_table).select("rule", "licence", "kind", "ids").where(F.size("ids") > 0), MAX_RULES, "rules")
    sequence = F.concat(F.lit(","), F.array_join(F.transform("licence_ids", lambda x: x.cast("string")), ",,"), F.lit(","))
    kind = "array<struct<rule:string,licence:string,kind:string>>"

    def hits(s: Column) -> Column:
        tried = []
        for r, longer in taken_before(rows):
            rest = s
            for x in longer:
                rest = F.regexp_replace(rest, pattern(x["ids"]), "".join(f"${i}" for i in range(1, len(x["ids"]))))
            there = s.rlike(pattern(r["ids"]))
            tried.append(F.when(there & rest.rlike(pattern(r["ids"])) if longer else there, F.struct(*[F.lit(r[c]).alias(c) for c in ("rule", "licence", "kind")])))
        return F.array_compact(F.array(*tried)) if tried else F.array().cast(kind)

    def strongest(found: Column) -> Column:
        strong = F.filter(found, lambda x: ~x["kind"].isin(*weak))
        return F.when(F.size(strong) > 0, strong).otherwise(found)

    found = docs.withColumn("licence_ids", sentence_ids(F.col("text"), known))
    hit = F.when(F.size("licence_ids") > 0, F.get(F.transform(F.transform(F.array(sequence), hits), strongest), F.lit(0)))
    found = found.withColumn("licences", hit)
    sorted_of = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x[c]))), F.array().cast("array<string>"))
    return found.withColumn("licence_kinds", sorted_of("kind")).withColumn("licence_rules", sorted_of("rule")).withColumn("licences", sorted_of("licence"))


def pattern(ids: list[int]) -> str:
    """Over the identifiers of a text, each with a comma on both sides; what stands between them is kept in groups."""
    return "(.*?)".join(f",{i}," for i in ids)


def report(docs: DataFrame) -> DataFrame:
    """One row per document, also of those without a licence."""
    found = scan(docs.select("doc_id", "text"))
    listed = lambda c, name: F.array_join(F.col(c).cast("array<string>"), ",").alias(name)
    return found.select("doc_id", listed("licence_ids", "sentence_ids"), listed("licences", "licences"), listed("licence_kinds", "kinds"), listed("licence_rules", "rules"))


def oracle() -> str:
    """The same in DuckDB."""
    values = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}', {str(more).lower()})" for i, t, more in SENTENCES)
    names = ", ".join(f"({i}, '{n.lower()}')" for i, n in NAMES)
    norm = lambda c: f"trim(regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' ')"
    cut = "string_split(regexp_replace(coalesce(text, ''), '[.!?:][ \\t\\r]|\\n', '\\0' || chr(1), 'g'), chr(1))"

    def held(r: dict, longer: list) -> str:
        rest = "q"
        for x in longer:
            rest = f"regexp_replace({rest}, '{pattern(x['ids'])}', '{''.join(chr(92) + str(i) for i in range(1, len(x['ids'])))}', 'g')"
        return f"SELECT r, '{r['rule']}' AS rule, '{r['licence']}' AS licence, '{r['kind']}' AS kind FROM found WHERE regexp_matches(q, '{pattern(r['ids'])}') AND regexp_matches({rest}, '{pattern(r['ids'])}')"

    rows = [dict(zip(("rule", "licence", "kind", "ids"), r, strict=True)) for r in RULES]
    held_rules = " UNION ALL ".join(held(r, longer) for r, longer in taken_before(rows))
    listed = lambda c: f"array_to_string(list_sort(list(DISTINCT {c})), ',')"
    weak = ", ".join(f"'{k}'" for k in WEAK)
    return rf"""
WITH pieces AS (SELECT sentence_id, more, unnest(regexp_split_to_array(t, '[.!?:]\s')) AS part FROM (VALUES {values}) v(sentence_id, t, more)),
known AS (SELECT sentence_id, arg_max({norm("part")}, (length({norm("part")}), {norm("part")})) AS s, any_value(more) AS more FROM pieces GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
parts AS (SELECT r, place, part, {norm("part")} AS s, CASE WHEN {norm("part")} = '' THEN 0 ELSE len(string_split({norm("part")}, ' ')) END AS n, regexp_matches(part, '[.!?:][ \t\r\n]*$') AS ends FROM (SELECT r, generate_subscripts({cut}, 1) AS place, unnest({cut}) AS part FROM docs)),
marked AS (SELECT *, lag(ends, 1, true) OVER w OR lag(s, 1, '') OVER w = '' OR s = '' AS new, lag(s) OVER w = '{MARKER}' AND regexp_matches(lag(part) OVER w, ':[ \t]$') AS named FROM parts WINDOW w AS (PARTITION BY r ORDER BY place)),
run AS (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY place) AS run FROM marked),
sized AS (SELECT *, sum(n) OVER (PARTITION BY r, run ORDER BY place DESC) AS upto, max(place) OVER (PARTITION BY r, run) AS z FROM run),
wrapped AS (SELECT a.r, a.place, string_agg(b.s, ' ' ORDER BY b.place) AS s FROM sized a JOIN sized b ON a.r = b.r AND a.run = b.run AND b.place >= a.place WHERE a.place < a.z AND a.upto IN (SELECT len(string_split(s, ' ')) FROM known) GROUP BY 1, 2),
opening AS (SELECT a.r, a.place, string_agg(b.s, ' ' ORDER BY b.place) AS s FROM sized a JOIN sized b ON a.r = b.r AND a.run = b.run AND b.place BETWEEN a.place AND a.place + (SELECT max(len(string_split(s, ' '))) FROM known WHERE more)
  WHERE a.place < a.z AND string_split(a.s, ' ')[1] IN (SELECT string_split(s, ' ')[1] FROM known WHERE more) GROUP BY 1, 2),
tokens AS (SELECT r, place, unnest(range(len(t))) AS j, unnest(t) AS t FROM (SELECT r, place, list_filter(regexp_split_to_array(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9.+-]+'), lambda x: x NOT IN ('', 'or', 'and')) AS t FROM marked WHERE named)),
names AS (SELECT r, place, t, lag(t, 1, '') OVER (PARTITION BY r, place ORDER BY j) AS before FROM tokens),
hit AS (SELECT DISTINCT r, place, sentence_id FROM (SELECT r, place, s FROM parts UNION ALL FROM wrapped) w JOIN known USING (s) WHERE s <> ''
  UNION SELECT r, place, sentence_id FROM (SELECT r, place, s FROM parts UNION ALL FROM opening) w JOIN known k ON k.more AND starts_with(w.s, k.s || ' ')
  UNION SELECT r, place, i FROM names JOIN (VALUES {names}) v(i, name) ON t = name WHERE before <> 'with'),
found AS (SELECT r, list(sentence_id ORDER BY place, sentence_id) AS ids, ',' || array_to_string(list(sentence_id ORDER BY place, sentence_id), ',,') || ',' AS q FROM hit GROUP BY 1),
held AS ({held_rules}),
strong AS (SELECT *, bool_or(kind NOT IN ({weak})) OVER (PARTITION BY r) AS others FROM held),
hits AS (SELECT r, {listed("licence")} AS licences, {listed("kind")} AS kinds, {listed("rule")} AS rules FROM strong WHERE NOT others OR kind NOT IN ({weak}) GROUP BY 1)
SELECT d.doc_id, coalesce(array_to_string(f.ids, ','), '') AS sentence_ids, coalesce(h.licences, '') AS licences, coalesce(h.kinds, '') AS kinds, coalesce(h.rules, '') AS rules
FROM docs d LEFT JOIN found f USING (r) LEFT JOIN hits h USING (r)"""
