"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

DataFrame functions only. Templates fall into length classes w = 8, 16, 32, ... words (w at least the template's length). For each class
windows of w + w/4 - 1 words start every w/4 words, so every run of w words lies whole in one of them. A window of W shingles
that holds c of a template's S is at least J = c / (W + S - c) alike to it. A band is one MinHash value (one row: short
templates in long windows have small J), and the number of bands is the least with 1 - (1 - J) ** bands >= SURE for the
fewest shingles c that count as contained, over all templates of the class.
Retrieved pairs are verified exactly: the share of the template's shingles that the window has.

Windows without any of the templates' shingles can't share a MinHash value with one; their signatures aren't computed.
Templates are the caller's bounded list: their shingles are literals of the plan (MOST_SHINGLES of them at most).
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import documents, stored

SHINGLE = 5
CONTAINED = 0.8
SURE = 0.999
MOST_SHINGLES = 50_000

#: Notices, opening paragraphs and whole texts of common licenses (fixed texts).
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _words(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def _chain(words: list[str]) -> int:
    """Spark's xxhash64 of several strings: each one's hash seeds the next."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def shingles(text: str) -> list[int]:
    """A template's different shingles; fewer words than a shingle are one."""
    w = _words(text)
    return sorted({_chain(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}) if w else []


def length_class(words: int) -> int:
    return max(8, 1 << (words - 1).bit_length())


def bands_for(least: float, sure: float = SURE) -> int:
    """The least number of one-row bands that finds a pair of that likeness with the wished probability."""
    return 1 if least >= 1 else math.ceil(math.log(1 - sure) / math.log(1 - least))


def likeness(shingles_of: int, window: int, contained: float) -> float:
    """The least Jaccard similarity of a template and a window that holds just enough of it."""
    c = math.ceil(contained * shingles_of - 1e-9)
    return c / (max(window, c) + shingles_of - c)


def _minhash(hashes: Column, k: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, template, containment, first_word, n_windows): templates that a document holds, one row for each pair.

    containment is the best window's, first_word where that window starts (the earliest of equals), n_windows how many
    windows reach ``contained``. Null, empty and wordless texts give no row; templates shorter than a shingle are matched
    as one shingle of their own length only if they have SHINGLE words at least (others raise ValueError). Repeated rows
    give repeated results: rows that share doc_id and text count apart only in number, as (doc_id, text) is read per row.
    An empty table gives none; very long texts are scanned whole; extra columns, whatever their names, are not looked at.
    """
    spark = df.sparkSession
    known = {name: (len(_words(t)), shingles(t)) for name, t in templates.items()}
    if short := [n for n, (k, _) in known.items() if k < SHINGLE]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    every = sorted({s for _, ss in known.values() for s in ss})
    if len(every) > MOST_SHINGLES:
        raise ValueError(f"over {MOST_SHINGLES} template shingles")
    classes = sorted({length_class(k) for k, _ in known.values()})
    bands = {}
    for w in classes:
        window = w + w // 4 - 1 - SHINGLE + 1
        bands[w] = bands_for(min(likeness(len(ss), window, contained) for k, ss in known.values() if length_class(k) == w))
    # One pass over the text: hashes of all shingles, and the places of those that some template has.
    none = F.array().cast("array<long>")
    split = documents(df, id_col, text_col).select("doc_id", words_of(F.col("text")).alias("w"))
    count = F.size("w") - (SHINGLE - 1)
    hashed = split.select("doc_id", F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(*[F.element_at("w", i + k) for k in range(SHINGLE)]))).otherwise(none).alias("h"))
    placed = hashed.select("doc_id", "h", F.filter(F.transform("h", lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull()).alias("at"))
    # Written once, with hashes of those documents alone that have a template's shingle: what follows reads them often.
    numbered = placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.size("at") > 0, F.col("h")).alias("h"), "at")
    found = stored(numbered, "license-shingles").filter("h is not null")

    def windows(w: int) -> Column:
        step, size = w // 4, w + w // 4 - 1 - SHINGLE + 1
        starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((i - (size - 1)) / step).cast("int")), F.floor(i / step).cast("int")), lambda s: s * step))))
        return F.transform(starts, lambda s: F.struct(F.lit(w).alias("class"), s.alias("start"), F.array_distinct(F.slice("h", s + 1, size)).alias("hashes")))

    each = found.select("row", "doc_id", F.explode(F.concat(*[windows(w) for w in classes])).alias("x")).select("row", "doc_id", "x.*")
    signed = each.withColumn("bands", F.coalesce(*[F.when(F.col("class") == w, F.array(*[F.struct(F.lit(k).alias("band"), _minhash(F.col("hashes"), k).alias("value")) for k in range(bands[w])])) for w in classes]))
    met = signed.select("row", "doc_id", "class", "start", "hashes", F.explode("bands").alias("b")).select("row", "doc_id", "class", "start", "hashes", "b.*")
    lists = spark.createDataFrame([(n, length_class(k), ss) for n, (k, ss) in known.items()], "template string, class int, own array<long>")
    most = max(bands.values())
    asked = lists.select("template", "class", "own", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _minhash(F.col("own"), k).alias("value")) for k in range(most)])).alias("b")).select("template", "class", "own", "b.*")
    hits = met.join(F.broadcast(asked), ["class", "band", "value"])  # MOST_SHINGLES bounds the templates
    share = F.size(F.array_intersect("own", "hashes")) / F.size("own")
    checked = hits.select("row", "doc_id", "template", "start", share.alias("share")).filter(F.col("share") >= contained).dropDuplicates(["row", "template", "start"])
    best = checked.groupBy("row", "doc_id", "template").agg(F.max(F.struct("share", (-F.col("start")).alias("back"))).alias("m"), F.count("*").alias("n_windows"))
    return best.select("doc_id", "template", F.col("m.share").alias("containment"), (-F.col("m.back")).cast("long").alias("first_word"), "n_windows")
