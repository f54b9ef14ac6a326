"""License scans as an exact set-similarity join, with DataFrame functions only.

Two things are found in every whole text:

* base places: a phrase's words standing consecutively among the text's words;
* template matches: text blocks whose distinct words contain at least
  ``threshold`` of a notice template's distinct words.

Blocks overlap and are sized by the template. Over the whole word sequence,
line breaks ignored, a block is any run of as many words as the template has,
so hard-wrapped notices are found. Within one line, where other words may stand
between, a block is any run of up to ``LINE_SPAN`` times as many words: a short
line is one block, and words scattered over a very long line do not add up.

The join is exact. Template words are put into one global order, rarest in
the corpus first (their counts cover every line). A block can reach the
threshold only if it holds one of the template's first ``size - need + 1``
words in that order (prefix filter), so only the blocks around these words'
positions are looked at (positional filter), and only where the text, the
line and then the words in reach of the position hold ``need`` template words
(length filter). What is left is verified by a full intersection. Templates
are a fixed parameter, so their index travels as a literal and no text is
shuffled.

The DuckDB text follows the same rule by brute force: every run of a text and
of each line that could hold a template is intersected with it, with no
prefixes, positions or order of words.

Defined results. Null text: as the empty text, which has no words, null
places, no labels and score 0. Repeated rows are scanned one by one. Empty
table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelstat.llm.common import ascii_lower, read_table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the contract.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Sentences of well-known public licence notices.
SENTENCES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license"
                   " is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                " general public license as published by the free software foundation either version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files to deal in the software without restriction"),
]

# Whole public notices, without names and years.
NOTICES = [
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsl-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy
at http://www.boost.org/LICENSE_1_0.txt)"""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("lgpl-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
Public License for more details."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
]
TEMPLATES = SENTENCES + [(label, re.sub(SEPARATORS, " ", text.lower()).strip()) for label, text in NOTICES]
THRESHOLD = 0.9
LINE_SPAN = 4  # within a line a block has at most so many times the template's words


def _words(lowered: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(lowered, SEPARATORS, " "), " "), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def template_counts(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Number of lines of all texts that hold each template word; at most one
    row per template word reaches the driver."""
    block = F.explode(F.split(ascii_lower(F.col(text_col)), "\n")).alias("block")
    held = F.filter(_words(F.col("block")), lambda w: w.isin(vocabulary))
    words = df.select(block).select(F.explode(F.array_distinct(held)).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def ordered_templates(templates: list[tuple[str, str]], counts: dict[str, int], threshold: float) -> list[tuple]:
    """(label, words rarest first, words needed, prefix, length in words) of each template."""
    out = []
    for label, text in templates:
        words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        out.append((label, words, need, words[:len(words) - need + 1], len(text.split())))
    return out


def most_held(words: Column, tokens: list[str], need: int, prefix: list[str], width: int) -> Column:
    """The most distinct ``tokens`` that ``width`` neighbouring words hold; 0 below ``need``."""

    def held(some: Column) -> Column:
        return F.size(F.array_intersect(some, _strings(tokens)))

    def around(i: Column) -> Column:
        """Over the blocks that hold place i."""
        first = F.greatest(F.lit(0), i - (width - 1))
        blocks = F.transform(F.sequence(first, i), lambda s: held(F.slice(words, s + 1, F.lit(width))))
        return F.when(held(F.slice(words, first + 1, i - first + width)) >= need, F.array_max(blocks)).otherwise(0)

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1),
                      lambda i: F.array_contains(_strings(prefix), F.get(words, i)))
    whole = held(words)
    most = F.when(F.size(words) <= width, whole).otherwise(
        F.coalesce(F.array_max(F.transform(places, around)), F.lit(0)))
    return F.when((F.size(words) >= need) & (whole >= need), F.when(most >= need, most)).otherwise(0)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_words``, ``n_base``,
    ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` (1
    with a base place, else the largest template containment that reaches the
    threshold, else 0) and ``matches`` (line number, label, containment; the
    line is null where a run across lines holds more than any line's)."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    index = ordered_templates(templates, template_counts(df, text_col, vocabulary), threshold)

    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = (df.select(F.col(id_col).alias("row_id"), text.alias("lowered"))
            .withColumn("words", _words(F.col("lowered")))
            .withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))

    def places(phrase: str) -> Column:
        tokens = phrase.split()

        def here(i: Column) -> Column:
            found = F.get("words", i) == tokens[0]
            for k, token in enumerate(tokens[1:], 1):
                found = found & (F.get("words", i + k) == token)
            return found

        none = F.array().cast("array<int>")
        starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        return F.when(F.contains(F.col("joined"), F.lit(f" {phrase} ")), starts).otherwise(none)

    for k, (phrase, _) in enumerate(phrases):
        rows = rows.withColumn(f"at_{k}", places(phrase))

    prefix_words = sorted({w for _, _, _, prefix, _ in index for w in prefix})

    def matches_of(words: Column, number: Column, span: int) -> Column:
        """Array of (block, label, containment) of one sequence of words."""

        def one(label: str, tokens: list[str], need: int, prefix: list[str], length: int) -> Column:
            # an array of one number, so that it is worked out once
            most = F.array(most_held(words, tokens, need, prefix, span * length))
            return F.transform(F.filter(most, lambda n: n >= need), lambda n: F.struct(
                number.alias("block"), F.lit(label).alias("label"),
                F.round(n / F.lit(float(len(tokens))), 6).alias("containment")))

        return F.flatten(F.array(*[one(*t) for t in index]))

    empty = F.array().cast("array<struct<block:int,label:string,containment:double>>")
    if index:

        def hit(words: Column) -> Column:
            return F.exists(words, lambda w: w.isin(prefix_words))

        lines = F.transform(F.split(F.col("lowered"), "\n"), _words)
        per_line = F.transform(lines, lambda ws, i: F.when(
            hit(ws), matches_of(ws, i, LINE_SPAN)).otherwise(empty))
        rows = (rows.withColumn("in_lines", F.when(hit(F.col("words")), F.flatten(per_line)).otherwise(empty))
                .withColumn("anywhere", F.when(hit(F.col("words")), matches_of(F.col("words"), F.lit(None).cast("int"), 1)).otherwise(empty)))
        found = F.concat("in_lines", F.filter("anywhere", lambda m: ~F.exists("in_lines", lambda x: (
            x["label"] == m["label"]) & (x["containment"] >= m["containment"]))))
    else:
        found = empty
    rows = rows.withColumn("matches", found)

    at = F.concat(*[F.col(f"at_{k}") for k in range(len(phrases))]) if phrases else F.array().cast("array<int>")
    named = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label))
                                      for k, (_, label) in enumerate(phrases)])) if phrases else _strings([])
    rows = rows.withColumn("at", at).withColumn("named", F.array_sort(F.array_distinct(named)))
    method = F.transform("matches", lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return rows.select(
        F.col("row_id").alias(id_col), F.size("words").cast("long").alias("n_words"),
        F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"), F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("named", method))), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(best).alias("score"), "matches")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("matches")


def _oracle() -> str:
    """Brute force in SQL: every run of the blocks' lengths, no filters but that the text, the line holds enough."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def words(col: str) -> str:
        return (f"list_filter(string_split(regexp_replace({col}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '),"
                " lambda x: x <> '')")

    def starts(phrase: str) -> str:
        test = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        return f"list_filter(range(len(words)), lambda i: {test})"

    def quoted(items: list[str]) -> str:
        return "[" + ", ".join(f"'{x}'" for x in items) + "]"

    rows = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {len(set(t.split()))}, {len(t.split())},"
                     f" {max(1, math.ceil(THRESHOLD * len(set(t.split())) - 1e-9))})" for label, t in TEMPLATES)
    named = ", ".join(f"CASE WHEN len(at_{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    return f"""
WITH d AS (SELECT doc_id, {lower} AS lowered FROM documents),
w AS (SELECT doc_id, lowered, {words('lowered')} AS words FROM d),
p AS (SELECT doc_id, lowered, len(words) AS n_words, {', '.join(f'{starts(p)} AS at_{k}' for k, (p, _) in enumerate(PHRASES))} FROM w),
q AS (SELECT doc_id, lowered, n_words, {' || '.join(f'at_{k}' for k in range(len(PHRASES)))} AS hits,
      list_filter([{named}], lambda x: x IS NOT NULL) AS named FROM p),
t AS (SELECT * FROM (VALUES {rows}) v(label, tokens, size, length, need)),
lines AS (SELECT doc_id, unnest(string_split(lowered, chr(10))) AS line FROM d),
blocks AS (SELECT doc_id, words AS block, 1 AS span FROM w
           UNION ALL SELECT doc_id, {words('line')} AS block, {LINE_SPAN} AS span FROM lines),
c AS (SELECT doc_id, block, label, tokens, size, need, span * length AS width FROM blocks, t
      WHERE len(list_intersect(block, tokens)) >= need),
r AS (SELECT doc_id, label, size, need, list_max(list_transform(range(greatest(1, len(block) - width + 1)),
             lambda i: len(list_intersect(list_slice(block, i + 1, i + width), tokens)))) AS n FROM c),
m AS (SELECT doc_id, label, n, size FROM r WHERE n >= need),
g AS (SELECT doc_id, list(label) AS found, max(round(n / size::DOUBLE, 6)) AS best FROM m GROUP BY doc_id)
SELECT q.doc_id, n_words::BIGINT AS n_words, len(hits)::BIGINT AS n_base, list_min(hits)::BIGINT AS first_word,
       list_max(hits)::BIGINT AS last_word, coalesce(array_to_string(list_sort(list_distinct(named)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(named || coalesce(found, []))), ','), '') AS labels,
       CASE WHEN len(hits) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM q LEFT JOIN g ON q.doc_id = g.doc_id
"""


ORACLE = _oracle()
