"""License scans: lines, whole documents and runs of lines against licence templates (DataFrame functions only).

Text is normalised (lower case, everything but letters and digits a space) and compared with each
template by the Dice coefficient over the sets of word bigrams. A template is tried only where the sizes
of both sets allow the threshold: 2 * min / (a + b) >= t. Templates are a bounded list, so the
comparison is one expression over each unit; nothing is joined or shuffled. Bigrams are compared by 64-bit hashes.

A match can lack only so many bigrams of its template (``_needed``), so one array per document, intersected once with
the needed bigrams of all templates, rules out nearly all documents, and nearly all templates for the others.

Units are each line of a document and the document as a whole (line -1); ``find_passages`` compares runs of
consecutive lines and sentences, so that a wrapped licence above other text is found. Its work on a document that holds
a template grows with the square of the template's length; ``read_templates`` takes whole licence texts from a folder.

Defined results: null and empty texts, and units of one word, match nothing; ties of templates go to the
alphabetically first name; repeated rows give their rows each; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Licence notices and texts by SPDX identifier; a name behind ``#`` tells variants apart.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause#notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0#short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT#text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: The closing paragraphs of four licences, which follow their permissions in a licence file.
CLOSINGS = {
    "BSD-2-Clause": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT#text": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
TEMPLATES |= {f"{name.split('#')[0]}#file": f"{TEMPLATES['BSD-2-Clause' if name == 'BSD-3-Clause' else name]} {closing}" for name, closing in CLOSINGS.items()}


def bigrams(text: str) -> list[str]:
    """Sorted distinct word bigrams of a normalised text."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Whole licence texts of a folder of files named by SPDX identifier (``.txt`` or no suffix); a bounded list by its nature."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("name"), "value").collect()
    return {f"{re.sub('[.]txt$', '', r['name'])}#file": r["value"] for r in rows}


def _needed(found: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every match holds one: as many as a match can lack, and one more; long ones are rare."""
    most = len(found) - math.ceil(len(found) * threshold / (2 - threshold) - 1e-9) + 1
    return sorted(found, key=lambda b: (-min(map(len, b.split())), -len(b), b))[:most]


def _constant(found: list[str]) -> Column:
    """Hashes of bigrams as one constant array: Spark's xxhash64 of two words is the hash of the second seeded by that of the first."""
    hashes = [xxhash.xxh64_intdigest(last, xxhash.xxh64_intdigest(first, 42)) for first, last in (b.split(" ") for b in found)]
    return F.expr(f"array({', '.join(f'{h - (h >> 63 << 64)}L' for h in hashes)})")


def _pairs(words: Column) -> Column:
    """Distinct hashes of the bigrams of an array of words, which is bound to a name first: a lambda would build it again for each word."""
    follow = lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.xxhash64(F.get(ws, i), w))
    return F.array_distinct(F.get(F.transform(F.array(words), follow), F.lit(0)))


def _with_needed(docs: DataFrame, known: dict[str, list[str]], threshold: float) -> DataFrame:
    """doc_id, text, needed: the rows that hold a needed bigram of a template, with the needed hashes found."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    every = sorted({b for held in known.values() for b in _needed(held, threshold)})
    there = F.array_intersect(_pairs(words), _constant(every))
    # A generator, not a filter: a filter would be pushed below and build the array again.
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.explode(F.filter(F.array(there), lambda a: F.size(a) > 0)).alias("needed"))


def _dice(found: Column, template: list[str], threshold: float) -> Column:
    """Dice coefficient, null where the sizes rule the threshold out or it is not reached."""
    n, m = F.size(found), len(template)
    low, high = m * threshold / (2 - threshold), m * (2 - threshold) / threshold
    dice = 2.0 * F.size(F.array_intersect(found, _constant(template))) / (n + m)
    return F.when((n >= low - 1e-9) & (n <= high + 1e-9), F.when(dice >= threshold, dice))


def find_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line, license, template, dice: one row for each line (or whole document, line -1) that matches."""
    known = {name: held for name, text in (templates or TEMPLATES).items() if (held := bigrams(text))}
    least = min(map(len, known.values())) * threshold / (2 - threshold)
    clean = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9\n]+", " "))
    units = _with_needed(docs, known, threshold).select("doc_id", F.split(clean, "\n").alias("lines"))
    whole = F.array_join("lines", " ")
    # A whole document of one line is that line.
    every = F.when(F.size("lines") > 1, F.concat("lines", F.array(whole))).otherwise(F.col("lines"))
    rows = units.select("doc_id", F.size("lines").alias("n"), F.posexplode(every).alias("line", "unit"))
    rows = rows.select("doc_id", F.when(F.col("line") == F.col("n"), -1).otherwise(F.col("line")).alias("line"), F.split(F.trim("unit"), " +").alias("words"))
    # A set of k bigrams needs k + 1 words at least; repeated bigrams make a text longer, never its set larger.
    held = rows.where(F.size("words") >= least + 1).select("doc_id", "line", _pairs(F.col("words")).alias("found"))
    scored = F.filter(F.array(*[F.struct(_dice(F.col("found"), b, threshold).alias("dice"), F.lit(name).alias("template")) for name, b in sorted(known.items())]), lambda s: s["dice"].isNotNull())
    best = F.aggregate(scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("template")), lambda a, s: F.when(s["dice"] > a["dice"], s).otherwise(a))
    # A generator, not a filter: a filter would be pushed below and build the bigrams once for each template.
    out = held.select("doc_id", "line", F.explode(F.filter(F.array(best), lambda b: b["dice"] > 0)).alias("best"))
    return out.select("doc_id", F.col("line").cast("int"), F.substring_index("best.template", "#", 1).alias("license"), F.col("best.template").alias("template"), F.round("best.dice", 6).alias("dice"))


def find_passages(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line, last_line, segment, license, template, dice: for each template the best run of consecutive lines or sentences from each place where one matches.

    A segment is a sentence, or the part of it on one line; a run starts at a segment with a bigram of its template and has
    words within the template's size bounds. Documents without any needed bigram of a template are not cut up for it.
    """
    texts = templates or TEMPLATES
    known = {name: held for name, text in texts.items() if (held := bigrams(text))}
    longest = {name: len(re.sub("[^a-z0-9]+", " ", texts[name].lower()).split()) for name in known}

    def template(name: str, held: list[str]) -> Column:
        low, high = math.ceil(len(held) * threshold / (2 - threshold) - 1e-9) + 1, int(longest[name] * (2 - threshold) / threshold) + 1
        there = F.arrays_overlap("needed", _constant(_needed(held, threshold)))
        return F.when(there, F.struct(F.lit(name).alias("name"), _constant(held).alias("held"), F.lit(low).alias("low"), F.lit(high).alias("high")))

    tried = F.filter(F.array(*[template(name, held) for name, held in sorted(known.items())]), lambda t: t.isNotNull())
    # Generators, not filters: a filter would be pushed below and build its arrays again.
    rows = _with_needed(docs, known, threshold).select("doc_id", "text", F.explode(tried).alias("t"))
    cut = F.regexp_replace(F.regexp_replace(F.lower("text"), "[.!?]+[\"')]*[ \t]+", "\u0001"), "[^a-z0-9\n\u0001]+", " ")
    parts = F.flatten(F.transform(F.split(cut, "\n"), lambda line, n: F.transform(F.split(line, "\u0001"), lambda s: F.struct(n.alias("line"), F.filter(F.split(s, " +"), lambda w: w != "").alias("words")))))
    rows = rows.select("doc_id", "t", F.filter(parts, lambda s: F.size(s["words"]) > 0).alias("parts"))
    # A bigram may begin in a segment and end in the next.
    reach = lambda p, i: F.concat(p["words"], F.slice(F.coalesce(F.get("parts", i + 1)["words"], F.array().cast("array<string>")), 1, 1))
    starts = F.filter(F.transform("parts", lambda p, i: F.when(F.arrays_overlap(_pairs(reach(p, i)), F.col("t.held")), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "t", "parts", F.explode(starts).alias("segment"))
    rows = rows.select("doc_id", "t", "segment", F.slice("parts", F.col("segment") + 1, F.col("t.high")).alias("run"))
    rows = rows.select("doc_id", "t", "segment", F.col("run.line").alias("lines"), F.flatten(F.col("run.words")).alias("words"), F.transform("run", lambda p: F.size(p["words"])).alias("sizes"))
    ends = F.transform("sizes", lambda _, k: F.struct(k.alias("k"), F.aggregate(F.slice("sizes", 1, k + 1), F.lit(0), lambda a, n: a + n).alias("n")))
    rows = rows.select("doc_id", "t", "segment", "lines", "words", F.filter(ends, lambda e: (e["n"] >= F.col("t.low")) & (e["n"] <= F.col("t.high"))).alias("ends"))

    def dice(end: Column) -> Column:
        found = _pairs(F.slice("words", 1, end["n"]))
        return F.struct((2.0 * F.size(F.array_intersect(found, F.col("t.held"))) / (F.size(found) + F.size("t.held"))).alias("dice"), (-end["k"]).alias("k"))

    best = F.array_max(F.transform("ends", dice))
    rows = rows.select("doc_id", "segment", "lines", F.col("t.name").alias("template"), F.explode(F.filter(F.array(best), lambda b: b["dice"] >= threshold)).alias("best"))
    return rows.select("doc_id", F.element_at("lines", 1).cast("int").alias("line"), F.get("lines", -F.col("best.k")).cast("int").alias("last_line"), "segment", F.substring_index("template", "#", 1).alias("license"), "template", F.round("best.dice", 6).alias("dice"))
