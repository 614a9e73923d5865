"""Licence scans with DataFrame expressions only.

A text is cut into statements (at lines and sentence ends, and at sentence ends
alone, so that wrapped notices count too), and is one statement as a whole, for
files that hold a licence and little else.  A statement and a template are the
sets of the word bigrams of their normalised words: lower case, letters a to z
and digits.  A statement bears a template's licence where their Dice
coefficient, 2 |A and B| / (|A| + |B|), reaches the threshold and is its greatest (of equal
ones, the first licence by name).

Sizes alone bound the coefficient, so each statement meets only templates whose
number of bigrams allows it.  Before that, texts and statements without any of
the templates' anchor words are passed over: anchors are chosen so that a
statement without them can't share enough bigrams with any template, so this
loses nothing.

Defined cases: a null or empty text bears no licence; repeated rows are treated
row by row; an empty table gives an empty result; statements of one word have
no bigrams; extra columns are not read.  Whole texts are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Paragraphs of licences that are short enough to be whole files.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."

# Notices and clauses as the licences word them, and whole licences.
TEMPLATES = [
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("ISC", _ISC),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL", "Licensed under the GNU Lesser General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
]

#: Words too common to anchor a template where another word will do.
ORDINARY = set("the of a an and or in on to is are this that under by for with without any all you may it not be as at".split())


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    found = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found, found[1:], strict=False)))


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words without one of which no statement reaches ``threshold`` with any template.

    A statement that reaches it with a template of n bigrams shares at least
    threshold / (2 - threshold) * n of them; words are taken until fewer than
    that are left untouched.
    """
    chosen: set[str] = set()
    for _, text in templates:
        left = [b.split() for b in bigrams(text)]
        needed = threshold / (2 - threshold) * len(left)
        left = [b for b in left if not chosen & set(b)]
        candidates = sorted(set(words(text)), key=lambda w: (w in ORDINARY, w.isdigit(), -len(w), w))
        for word in candidates:
            if len(left) < needed - 1e-9:
                break
            if any(word in b for b in left):
                chosen.add(word)
                left = [b for b in left if word not in b]
    return sorted(chosen)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, text: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with ``into``: an array of (licence, dice), one for each licence with its best coefficient, by licence."""
    templates = templates or TEMPLATES
    marks = anchors(templates, threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(bigrams(t)) for _, t in templates]
    names = {n: f"__{into}_{n}" for n in ("low", "statements", "words", "bigrams", "hits")}
    lower = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    any_mark = "(?<![a-z0-9])(?:" + "|".join(marks) + ")(?![a-z0-9])"
    nothing = F.array().cast("array<string>")
    cut = F.array_distinct(F.concat(F.split(F.col(names["low"]), r"[.!?;]+\s+|[\r\n]+", -1), F.split(F.translate(F.col(names["low"]), "\r\n", "  "), r"[.!?;]+\s+", -1), F.array(F.col(names["low"]))))
    order = sorted({licence for licence, _ in templates})
    known = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(-order.index(licence)).alias("minus"), F.lit(len(b)).alias("size"), F.array(*[F.lit(x) for x in b]).alias("bigrams")) for licence, t in templates if (b := bigrams(t))])

    def split_words(statement: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(statement, "[^a-z0-9]+", " ")), " ", -1)

    def pairs(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    def dice(b: Column) -> Column:
        near = F.filter(known, lambda t: (t["size"] >= F.size(b) * low - 1e-9) & (t["size"] <= F.size(b) * high + 1e-9))
        return F.array_max(F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["size"])).alias("dice"), t["minus"].alias("minus"), t["licence"].alias("licence"))))

    out = docs.withColumn(names["low"], lower)
    out = out.withColumn(names["statements"], F.when(F.col(names["low"]).rlike(any_mark), F.filter(cut, lambda s: s.rlike(any_mark))).otherwise(nothing))
    out = out.withColumn(names["words"], F.transform(names["statements"], split_words))
    longest = int(max(sizes) * high) + 1  # a set may hold fewer bigrams than there are words, so length bounds come after it
    out = out.withColumn(names["bigrams"], F.filter(F.transform(F.filter(names["words"], lambda w: F.size(w) >= 2), pairs), lambda b: (F.size(b) >= min(sizes) * low - 1e-9) & (F.size(b) <= longest)))
    out = out.withColumn(names["hits"], F.filter(F.transform(names["bigrams"], dice), lambda h: h["dice"] >= threshold))
    licences = F.array_sort(F.array_distinct(F.transform(names["hits"], lambda h: h["licence"])))
    best = lambda name: F.array_max(F.transform(F.filter(names["hits"], lambda h: h["licence"] == name), lambda h: h["dice"]))
    return out.withColumn(into, F.transform(licences, lambda n: F.struct(n.alias("licence"), best(n).alias("dice")))).drop(*names.values())


def op8_licence_scan(spark, sf_dir: str) -> DataFrame:
    """The licences of every document, with the best coefficient in thousandths."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join(F.transform("found", lambda h: h["licence"]), ",").alias("licences"),
        F.size("found").cast("long").alias("n_licences"),
        F.coalesce(F.floor(F.array_max(F.transform("found", lambda h: h["dice"])) * 1000 + 1e-9), F.lit(0)).cast("long").alias("best_dice"),
    )


def oracle_sql() -> str:
    """The same by every statement against every template."""
    rows = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{b}'" for b in bigrams(t))) for name, t in TEMPLATES)
    return rf"""WITH t(licence, b) AS (VALUES {rows}),
l AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents),
s AS (SELECT doc_id, unnest(list_concat(regexp_split_to_array(x, '[.!?;]+\s+|[\r\n]+'), regexp_split_to_array(replace(replace(x, chr(13), ' '), chr(10), ' '), '[.!?;]+\s+'), [x])) AS u FROM l),
w AS (SELECT doc_id, regexp_extract_all(u, '[a-z0-9]+') AS w FROM s),
g AS (SELECT DISTINCT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, g, licence, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t WHERE len(b) >= len(g) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(b) <= len(g) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY dice DESC, licence) AS n FROM m WHERE dice >= {THRESHOLD}),
h AS (SELECT doc_id, licence, max(dice) AS dice FROM o WHERE n = 1 GROUP BY ALL),
a AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences, count(*) AS n_licences, CAST(floor(max(dice) * 1000 + 1e-9) AS BIGINT) AS best_dice FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n_licences, 0) AS n_licences, coalesce(best_dice, 0) AS best_dice FROM documents d LEFT JOIN a USING (doc_id)"""
