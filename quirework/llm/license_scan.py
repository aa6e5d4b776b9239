"""Licence notices found by the Dice coefficient of word bigrams. DataFrame functions only."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.grouped import pack, unpacked

#: Notices as their licences word them, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-proprietary", "All rights reserved."),
    # whole grants, conditions and disclaimers, which stand in files of their own or at their heads
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense")),
]
#: What separates the words of a normalised text.
GAP = r"[^\p{L}\p{N}]+"
FOUND = "struct<dice:double,place:int,start:int,end:int,license:string>"
HITS = "array<struct<segment:string,license:string,dice:double>>"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    last = F.size(words) - 2
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))


def bounds(least: float) -> tuple[float, float]:
    """The least and greatest ratio of two sets' sizes at a coefficient of least, with room for the rounding of floats."""
    return least / (2 - least) - 1e-9, (2 - least) / least + 1e-9


def _table(grams: Sequence[tuple[str, list[str]]], least: float) -> Column:
    """The templates as one array of structs, which the optimiser folds to a literal: the plan doesn't grow with them."""
    low, high = bounds(least)
    rows = [{"place": i, "name": name, "grams": t, "n": len(t), "low": len(t) * low, "high": len(t) * high, "most": int(len(t) * high), "fewest": int(len(t) * low)} for i, (name, t) in enumerate(grams)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<place:int,name:string,grams:array<string>,n:int,low:double,high:double,most:int,fewest:int>>")


def _gram(w: Column, i: Column) -> Column:
    return F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))


def _first(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once: an array of one binds what is used often."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _windows(w: Column, templates: Column, grams: Sequence[tuple[str, list[str]]], least: float) -> Column:
    """The stretches of an array of words that are notices, as structs like those of hits, though no segment is cut there.

    A stretch starts and ends with a bigram of its template, since another one at its ends only lowers the coefficient, and has
    at most as many bigrams as the bound on sizes allows. Each start takes its best end; of stretches that overlap the best
    stays, of equals the one of the template listed first, then the first.
    """
    every = sorted({x for _, g in grams for x in g})
    firsts = sorted({x.split(" ")[0] for x in every})
    different = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda x: x["g"])))
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.get(w, i).isin(firsts) & _gram(w, i).isin(every))
    marks = F.transform(at, lambda i: F.struct(i.alias("at"), _gram(w, i).alias("g")))

    def window(t: Column, a: Column, b: Column, near: Column) -> Column:
        n = F.size(F.array_distinct(F.transform(F.sequence(a["at"], b["at"]), lambda i: _gram(w, i))))
        dice = different(F.filter(near, lambda x: x["at"] <= b["at"])) * 2.0 / (n + t["n"])
        return F.struct(dice.alias("dice"), (-t["place"]).alias("place"), (-a["at"]).alias("start"), (-b["at"]).alias("end"), t["name"].alias("license"))

    def from_start(t: Column, a: Column, i: Column, mine: Column) -> Column:
        # places are different, so that no more marks than a stretch may have bigrams stand in it
        near = F.filter(F.slice(mine, i + 1, t["most"]), lambda b: b["at"] < a["at"] + t["most"])
        ends = lambda ns: F.filter(ns, lambda b: b["at"] >= a["at"] + t["fewest"] - 1)
        return _first(near, lambda ns: F.when(different(ns) >= t["low"], F.array_max(F.transform(ends(ns), lambda b: window(t, a, b, ns)))))

    def of_template(t: Column, ms: Column) -> Column:
        mine = F.filter(ms, lambda m: F.array_contains(t["grams"], m["g"]))
        starts = lambda m: F.filter(F.transform(m, lambda a, i: from_start(t, a, i, m)), lambda x: x["dice"] >= least)
        return _first(mine, lambda m: F.when(different(m) >= t["low"], starts(m)).otherwise(F.array().cast(f"array<{FOUND}>")))

    found = _first(marks, lambda ms: F.sort_array(F.flatten(F.transform(templates, lambda t: of_template(t, ms))), asc=False))
    # start and end are negative, so that the first of equals comes first
    apart = F.aggregate(found, F.array().cast(f"array<{FOUND}>"), lambda s, x: F.when(F.exists(s, lambda y: (x["start"] >= y["end"] - 1) & (y["start"] >= x["end"] - 1)), s).otherwise(F.concat(s, F.array(x))))
    wording = lambda x: F.array_join(F.slice(w, 1 - x["start"], x["start"] - x["end"] + 2), " ")
    return F.transform(apart, lambda x: F.struct(wording(x).alias("segment"), x["license"].alias("license"), x["dice"].alias("dice")))


def scan(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), least: float = 0.8) -> DataFrame:
    """docs with _hits: array of (segment, license, dice), a row's licence notices in order.

    Segments are the lines of a text, its paragraphs between empty lines where it has such, and the whole. Each is lower-cased
    and cut into words of letters and digits; 2 * common / (own + template's) of the sets of word bigrams is its Dice
    coefficient. At a coefficient of `least` the sets' sizes differ by (2 - least) / least times at most, so that a segment
    meets only the templates within these bounds, and most lines none; a text without a long bigram of any template meets none. A segment takes its best template, of equals the first
    listed; segments of one wording count once. Notices that stand in none of these, within a line or wrapped within a longer
    text, are found as windows over the words of the whole; a window whose wording stands within a hit segment is that hit. Null and empty texts, and texts without a bigram, have no hits. A column of docs that is called _hits gives way. Rows are
    scanned one by one, so that ids may be null or repeat. Empty table: no rows. There is no shuffle.
    """
    grams = [(name, g) for name, t in templates if (g := template_bigrams(t))]
    low, high = bounds(least)
    fewest, most = min(len(g) for _, g in grams) * low, max(len(g) for _, g in grams) * high
    templates_ = _table(grams, least)
    none = F.array().cast(HITS)
    inside = lambda x, hs: F.exists(hs, lambda h: F.concat(F.lit(" "), h["segment"], F.lit(" ")).contains(F.concat(F.lit(" "), x["segment"], F.lit(" "))))

    def hit(words: Column, g: Column) -> Column:
        n = F.size(g)
        # structs order by the coefficient, then by the earlier template
        one = lambda t: F.when((n >= t["low"]) & (n <= t["high"]), F.struct((F.size(F.array_intersect(g, t["grams"])) * 2.0 / (n + t["n"])).alias("dice"), (-t["place"]).alias("place"), t["name"].alias("license")))
        return _first(F.array_max(F.transform(templates_, one)), lambda best: F.struct(F.array_join(words, " ").alias("segment"), best["license"].alias("license"), best["dice"].alias("dice")))

    def hits(body: Column, whole: Column) -> Column:
        paragraphs = F.when(body.rlike(r"\n\s*\n"), F.split(body, r"\n\s*\n")).otherwise(F.array().cast("array<string>"))
        lines = F.transform(F.concat(F.split(body, "\n"), paragraphs), _words)
        # a text of one line is that line; of more, the whole is the words of all lines
        segments = F.filter(F.array_distinct(F.concat(lines, F.array(whole))), lambda w: F.size(w) > fewest)
        # bigrams number one less than the words at most; the bound on distinct ones is held per template
        fits = F.filter(F.transform(segments, lambda w: F.struct(w.alias("w"), F.when(F.size(w) > 1, _bigrams(w)).alias("g"))), lambda s: (F.size(s["g"]) >= fewest) & (F.size(s["g"]) <= most))
        return F.filter(F.transform(fits, lambda s: hit(s["w"], s["g"])), lambda h: h["dice"] >= least)

    def every(whole: Column) -> Column:
        windows = F.coalesce(_windows(whole, templates_, grams, least), none)
        return _first(F.coalesce(hits(F.col("body"), whole), none), lambda hs: F.concat(hs, F.filter(F.array_distinct(windows), lambda x: ~inside(x, hs))))

    # a hit shares at least low of its template's bigrams, so that it has one of any 1 - low and one more of them: the longest,
    # which few texts hold. A text without any of these keys has no hit and is done with
    keys = sorted({x for _, t in grams for x in sorted(t, key=lambda x: (-len(x), x))[: len(t) - math.ceil(len(t) * low) + 1]})
    firsts = sorted({x.split(" ")[0] for x in keys})
    has_key = lambda w: F.exists(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.get(w, i).isin(firsts) & _gram(w, i).isin(keys))
    whole = F.flatten(F.transform(F.split(F.col("body"), "\n"), _words))
    found = F.coalesce(_first(whole, lambda w: F.when(F.size(w) > 1, F.when(has_key(w), every(w)))), none)
    own = [c for c in docs.columns if c.lower() != "_hits"]
    return pack(docs, (), body=F.col(f"`{text}`")).select("row", found.alias("hits")).select(*unpacked(own), F.col("hits").alias("_hits"))


def scan_sql(templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), least: float = 0.8) -> str:
    """The digest of op2 in DuckDB's SQL."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(chr(39) + x + chr(39) for x in g)}])" for i, (name, t) in enumerate(templates) if (g := template_bigrams(t)))
    return rf"""
WITH t(place, license, grams) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), list_concat([text], CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_split_to_array(text, '\n\s*\n') ELSE [] END))) AS seg FROM d),
w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(seg), '[\p{{L}}\p{{N}}]+') AS w FROM s),
g AS (SELECT doc_id, array_to_string(w, ' ') AS segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1 AND len(w) < 2000),
m AS (SELECT doc_id, segment, license, place, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, t),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY dice DESC, place) AS r FROM m WHERE dice >= {least}),
a AS (SELECT doc_id, count(*) AS n, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM b WHERE r = 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, CAST(dice AS DOUBLE) AS best_dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
