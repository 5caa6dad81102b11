"""Licence scans: normalised text against templates by the Dice coefficient over word bigrams.

A document's units (its whole text, its blocks between blank lines, its lines) become words of A-Z, a-z and 0-9 in lower
case and sets of two-word grams. A unit is compared only with templates whose gram count leaves a coefficient of
`threshold` possible: every count a template admits is a row of a small fixed table, so that pruning is an equality join. As a matching
unit shares most grams with its template, it holds one of a few words of the templates (`telling_words`); texts and units without any of
these are not cut into grams. That leaves out no match. DataFrame functions only.

Defined cases: null and empty texts, and units of fewer than two words, match nothing (license null, dice 0, licenses '');
ties go to the licence whose name comes first; repeated rows give a row each; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices of public licences, by SPDX identifier.
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("all-rights-reserved", "All rights reserved."),
]


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def template_sizes(threshold: float, templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """(unit's gram count, licence, template's grams) wherever 2 min(a, b) / (a + b) reaches the threshold."""
    out = []
    for name, text in templates:
        own = bigrams(text)
        b = len(own)
        out += [(a, name, own) for a in range(1, math.ceil(b * (2 - threshold) / threshold) + 2) if 2 * min(a, b) >= threshold * (a + b)]
    return out


def telling_words(threshold: float, templates: list[tuple[str, str]]) -> list[str]:
    """Words of which every unit that matches a template holds one at least, longer ones first.

    A unit without them lacks all the template's grams in which they occur: they are taken until the grams left are too few for the threshold."""
    left = []
    for _, text in templates:
        sizes = [(a, own) for a, _, own in template_sizes(threshold, [("", text)])]
        if sizes:
            own = sizes[0][1]
            least = min(next(n for n in range(a + len(own) + 1) if 2.0 * n / (a + len(own)) >= threshold) for a, _ in sizes)
            left.append((set(own), len(own) - least + 1))  # its grams, and how many of them must go
    chosen = []
    while left:
        words = sorted({w for grams, _ in left for gram in grams for w in gram.split()})
        best = max(words, key=lambda w: (len(w) > 5 or 0.01) * sum(min(n, sum(w in gram for gram in grams)) for grams, n in left))
        chosen.append(best)
        rest = [({gram for gram in grams if best not in gram}, grams, n) for grams, n in left]
        left = [(kept, n - len(grams) + len(kept)) for kept, grams, n in rest if n > len(grams) - len(kept)]
    return chosen


def _holds_one(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, within longer ones too."""
    # the lambda's variable lower-cases once
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [t.contains(w) for w in words], F.lit(False)))


def _grams(words: Column) -> Column:
    pairs = F.expr("transform(array(w), v -> CASE WHEN size(v) > 1 THEN transform(sequence(0, size(v) - 2), i -> concat(v[i], ' ', v[i + 1])) ELSE CAST(array() AS array<string>) END)[0]")
    return F.array_distinct(pairs)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license (the best match), dice, licenses (all that match, sorted, comma-joined) for every row of docs."""
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sizes, words = template_sizes(threshold, templates), telling_words(threshold, templates)
    admitted = spark.createDataFrame(sizes, "n int, name string, grams array<string>")  # a few hundred rows, whatever the corpus
    most = max([a for a, _, _ in sizes], default=0)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    text = F.coalesce("text", F.lit(""))
    units = docs.filter(_holds_one(text, words)).select("doc_id", "h", F.explode(F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n")))).alias("unit")).filter(_holds_one(F.col("unit"), words))
    # a unit of n grams has more than n words; one with too many words may still repeat them, so only its distinct grams count
    listed = units.select("doc_id", "h", F.transform(F.regexp_extract_all("unit", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower).alias("w")).filter(F.size("w") > 1)
    grams = listed.select("doc_id", "h", _grams(F.col("w")).alias("own")).filter(F.size("own") <= most)
    matched = grams.join(F.broadcast(admitted), F.size("own") == F.col("n")).select("doc_id", "h", "name", (2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams"))).alias("dice")).filter(F.col("dice") >= threshold)
    found = matched.groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")).agg(F.min(F.struct((-F.col("dice")).alias("d"), "name")).alias("best"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("licenses"))
    out = docs.select("doc_id", "h").join(found, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("h").eqNullSafe(F.col("m_h")), "left")
    return out.select("doc_id", F.col("best.name").alias("license"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan(documents)."""
    values = ", ".join(f"('{name}', {[*bigrams(text)]})" for name, text in TEMPLATES)
    return f"""
WITH t(name, grams) AS (VALUES {values}),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')), string_split(text, chr(10)))) AS unit FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_transform(regexp_extract_all(unit, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM units),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
m AS (SELECT g.doc_id, t.name, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM g JOIN t ON 2 * least(len(own), len(grams)) >= {threshold} * (len(own) + len(grams))),
b AS (SELECT doc_id, name, dice FROM m WHERE dice >= {threshold}),
r AS (SELECT doc_id, name, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS nth FROM b),
a AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT DISTINCT doc_id, name FROM b) GROUP BY doc_id)
SELECT d.doc_id, r.name AS license, coalesce(r.dice, 0.0::DOUBLE) AS dice, coalesce(a.licenses, '') AS licenses
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.nth = 1 LEFT JOIN a ON d.doc_id = a.doc_id
"""
