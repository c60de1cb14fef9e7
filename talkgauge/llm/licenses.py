"""License scans: MinHash bands over overlapping windows of text find templates, exact containment of shingles verifies them.

Everything on the way is DataFrame functions. A text's words (runs of letters and digits, A-Z in lower case) are hashed
once; a window holds WINDOW shingles of five words and begins STEP shingles after the one before it, so neighbours share half of theirs. A window's
MinHash under a permutation is its least shingle hash, each hash XORed with the permutation's number, so two windows agree under one
with the probability of their Jaccard similarity. A band is ROWS permutations; windows whose similarity is s share one of
BANDS bands with probability 1 - (1 - s^2)^6: 0.996 if they differ in one shingle of eight, 0.93 in two, 0.67 in three.

Long templates (LONG shingles or more) are cut into windows at ANCHORS places, STEP windows in a row at each, or at every place if they have fewer. A text
window that lies inside a copy is the same as one of such a row if that is at its place, and so agrees in all bands. A share of four fifths of a
template's shingles leaves at least two fifths of all places unspoilt, however many words are changed, left out or put in, since each costs four or five; that all rows meet
spoilt windows only, and no band of those agrees, has a probability below 1 in 1,000 for changes at random places (tests compute and measure it).

Short templates have fewer shingles than two windows, which leaves MinHash nothing to estimate. For them the same rows stand for windows of two shingles with two
bands, the least and the greatest hash; these find each shingle of a text for certain. Of any fifth of a template's shingles and one more
the text holds at least one, so that many are looked for and no short template is missed.

What is reported is exact: the share of a template's distinct shingles that the text contains, if it is at least 0.8.

Templates are a table or a dictionary. A null text or one with fewer than five words holds nothing, nor is such a template looked for: it has no
shingle. Rows that share an id count as one document, with the greatest share that one of them has. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm.common import lower_ascii, materialize

SHINGLE = 5
WINDOW, STEP = 8, 4
BANDS, ROWS = 6, 2
#: Shingles of a long template.
LONG = 16
#: Places of a long template whose windows are indexed.
ANCHORS = 16
MIN_CONTAINMENT = 0.8
#: Bands of templates that are broadcast at most (40 bytes each), and shingles of templates (some 40 bytes each); beyond either the joins are shuffle joins.
BROADCAST_BANDS, BROADCAST_SHINGLES = 500_000, 500_000
#: Of each permutation, the number that hashes are XORed with: the high bits part them, the rest is the golden ratio's.
PERMUTATIONS = [((i << 60) | (i * 0x9E3779B97F4A7C15 & (1 << 60) - 1)) - (1 << 64 if i >> 3 else 0) for i in range(BANDS * ROWS)]

# Public license notices and whole licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _shingle_hash(hashes: Column, start: Column, n: Column) -> Column:
    """The hash of the shingle that begins at a place; null where the text ends before it does."""
    whole = F.xxhash64(*[F.get(hashes, start + i) for i in range(SHINGLE)])
    return F.when(start + SHINGLE <= n, whole)


def _windows(rows: DataFrame, *kept: str) -> DataFrame:
    """The shingle hashes ``h0`` to ``h7`` of the windows that begin at ``start``; fewer at a text's end. least() passes over nulls."""
    return rows.select(*kept, *(_shingle_hash(F.col("hashes"), F.col("start") + i, F.col("n")).alias(f"h{i}") for i in range(WINDOW)))


def window_bands() -> list[Column]:
    """The bands of a window of shingle hashes."""
    least = [F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(x).cast("long")) for i in range(WINDOW)]) for x in PERMUTATIONS]
    return [F.xxhash64(F.lit(band), *least[band * ROWS : (band + 1) * ROWS]) for band in range(BANDS)]


def band_probability(similarity: float) -> float:
    """The probability that two windows of a Jaccard similarity share a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """``template_id, words, hashes, n, shingles``: distinct shingles as text with a space on both sides."""
    if isinstance(templates, dict):
        templates = spark.createDataFrame(sorted(templates.items()), "template_id string, text string")
    rows = templates.select("template_id", words(F.col("text")).alias("words"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    each = F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("words", i + 1, SHINGLE), " "), F.lit(" ")))
    return rows.filter(F.col("n") >= SHINGLE).withColumn("shingles", F.array_distinct(each))


def template_bands(table: DataFrame) -> DataFrame:
    """``band, template_id, t_window``: bands of long templates' windows, and single hashes of short ones (without a window)."""
    n = F.col("n") - SHINGLE + 1
    long = n >= LONG
    last = n - WINDOW
    spread = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ANCHORS - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda j: F.floor(i * (last + 1 - STEP) / (ANCHORS - 1)).cast("int") + j)))
    starts = F.when(last + 1 <= ANCHORS * STEP, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(spread)
    windows = _windows(table.filter(long).select("template_id", "hashes", "n", F.explode(starts).alias("start")), "template_id")
    banded = windows.select(F.explode(F.array(*window_bands())).alias("band"), "template_id", _window().alias("t_window"))
    # Of a fifth of the distinct shingles and one more, a text that has four fifths of them holds one.
    hashed = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + j) for j in range(SHINGLE)])))
    short = table.filter(~long).select("template_id", hashed.alias("all"))
    some = F.slice("all", F.lit(1), F.floor(F.size("all") * (1 - MIN_CONTAINMENT) + 1e-9).cast("int") + 1)
    return banded.union(short.select(F.explode(some).alias("band"), "template_id", F.lit(None).cast("long").alias("t_window"))).distinct()


def _window() -> Column:
    return F.xxhash64(*[F.col(f"h{i}") for i in range(WINDOW)])


def text_bands(rows: DataFrame, *kept: str) -> DataFrame:
    """``band, number, window`` and the columns to keep: the bands of all windows of the rows' words (numbered from 0), and behind them the least and
    greatest hash of each two shingles, which are the STEP shingles that a window has before the next one."""
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    starts = F.when(F.col("n") >= SHINGLE, F.sequence(F.lit(0), F.col("n") - SHINGLE, F.lit(STEP)))
    windows = _windows(rows.select(*kept, "hashes", "n", F.explode(starts).alias("start")), *kept)
    pairs = [f(F.col(f"h{i}"), F.col(f"h{i + 1}")) for i in range(0, STEP, 2) for f in (F.least, F.greatest)]
    return windows.select(*kept, _window().alias("window"), F.posexplode(F.array(*window_bands(), *pairs)).alias("number", "band"))


def _first_of_equal() -> Column:
    """Of bands only windows' meet windows'; of windows that are the same the first band is enough."""
    return F.when(F.col("t_window").isNull(), F.col("number") >= BANDS).otherwise((F.col("number") < BANDS) & ((F.col("number") == 0) | (F.col("window") != F.col("t_window"))))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", min_containment: float = MIN_CONTAINMENT, broadcast_bands: int = BROADCAST_BANDS) -> DataFrame:
    """``doc_id, template_id, n_shingles, found_shingles, containment`` for each template of which a document holds min_containment, at least 0.8.

    ``templates`` has ``template_id, text``; those of this module if there are none.
    """
    if min_containment < MIN_CONTAINMENT:
        raise ValueError(f"bands are set for a containment of {MIN_CONTAINMENT} and more")
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    bands, shingles = template_bands(table), table.select("template_id", "shingles")
    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    if bands.count() <= broadcast_bands and (table.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        hits = text_bands(rows, "doc_id", "words").join(F.broadcast(bands), "band").filter(_first_of_equal()).join(F.broadcast(shingles), "template_id")
    else:  # a text isn't shuffled with each of its bands: only rows and templates that meet are joined with it
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
        met = text_bands(rows, "row").join(bands, "band").filter(_first_of_equal()).select("row", "template_id").distinct()
        hits = rows.join(met, "row").join(shingles, "template_id")
    whole = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    found = hits.select("doc_id", "template_id", F.size("shingles").alias("n_shingles"), whole.alias("whole"), "shingles")
    found = found.select("doc_id", "template_id", "n_shingles", F.size(F.filter("shingles", lambda s: F.contains(F.col("whole"), s))).alias("found_shingles"))
    # The greatest is asked for after the join, so that nothing but hashes is compared inside it.
    best = found.groupBy("doc_id", "template_id", "n_shingles").agg(F.max("found_shingles").alias("found_shingles"))
    return best.filter(F.col("found_shingles") >= F.col("n_shingles") * F.lit(min_containment)).withColumn("containment", F.col("found_shingles") / F.col("n_shingles"))
