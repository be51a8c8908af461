"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Texts and templates are cut into shingles of five normalised words.  For a template of ``w`` shingles a text is read in windows
of ``w`` shingles that overlap by three quarters.  A window that holds the template's text shares at least half its shingles
with it, wherever it starts; ``BANDS`` bands of ``ROWS`` minimum hashes then collide with probability
``collision_probability(0.5)``, over 0.99.  Retrieved templates are verified on the shingles themselves: at least
``CONTAINMENT`` of the template's must be in the text.

Windows without any shingle of a template of their width cannot be verified, so only windows around such shingles are signed;
this skips nothing that could match.  A document is never copied: its windows are signed where it lies, band values that no
template has are dropped there, and only documents with a retrieved template go on, with the template shingles they hold.

Long licenses are looked for by the notices their publishers give; short ones by their whole text, paragraph by paragraph, so a
document with one paragraph of a license is found too.

Nulls: a null text is like an empty one and has no matches.  Each row is a document of its own, also where doc_ids are equal or
null: equal rows give equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import WORD, text_or_empty
from emberlog.llm.quality import let

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 24, 2
#: Characters that are no part of a word; capitals become small letters.
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>`"
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PUNCTUATION
_TO = "abcdefghijklmnopqrstuvwxyz"

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, subject: str, versions: str) -> str:
    return f"{subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either {versions}, or (at your option) any later version."


#: Notices and texts of licenses, as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", f"{_AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("General Public License", "This program", "version 3 of the License")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", _gnu("Lesser General Public License", "This library", "version 3 of the License")),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", _gnu("Affero General Public License", "This program", "version 3 of the License")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_SOURCE}"),
    ("BSD-3-Clause", f"{_BSD_BINARY} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", f"Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
)


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _FROM, _TO), F.lit(WORD), 0)


def shingle_hashes(words: Column) -> Column:
    """A hash per shingle; none for fewer words than a shingle has."""
    last = F.size(words) - SHINGLE
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def shingle_at(words: Column, place: Column) -> Column:
    return F.concat_ws(" ", *(F.get(words, place + k) for k in range(SHINGLE)))


def shingle_texts(words: Column) -> Column:
    last = F.size(words) - SHINGLE
    texts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: shingle_at(words, i))
    return F.when(last >= 0, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def band_values(hashes: Column) -> Column:
    """One value per band of the set's minimum hashes."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, w, hashes, shingles): w is the number of shingles; templates need five words."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text")) for k, (n, t) in enumerate(templates)))
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.license", normal_words(F.col("t.text")).alias("words"))
    table = table.select("template", "license", shingle_hashes(F.col("words")).alias("hashes"), shingle_texts(F.col("words")).alias("shingles"))
    return table.withColumn("w", F.size("hashes")).where("w > 0")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, template, first_word) of ``docs`` (doc_id, text): one row per document row and license.

    ``containment`` is the share of the best template's shingles that the text has; ``first_word`` is the number (from 0) of
    the text's first word at which one of them starts.
    """
    table = template_table(docs.sparkSession, templates)
    bands = table.select("template", "license", "shingles", F.explode(band_values(F.col("hashes"))).alias("value"))
    known = table.select("w", "hashes").collect()  # as many rows as templates
    anchors = sorted({h for r in known for h in r["hashes"]})
    by_width: dict[int, set[int]] = {}
    for r in known:
        by_width.setdefault(r["w"], set()).update(r["hashes"])
    values = sorted({r["value"] for r in bands.select("value").collect()})  # BANDS per template

    def places(hashes: Column) -> Column:
        found = F.transform(hashes, lambda h, i: F.when(h.isin(anchors), F.struct(h.alias("h"), (i + 0).alias("i"))))
        return F.filter(found, lambda p: p.isNotNull())

    def windows(at: Column) -> Column:
        def around(w: int) -> Column:
            stride = -(-w // 4)

            def of(p: Column) -> Column:
                first = F.greatest(F.lit(0), F.floor((p["i"] - w) / stride).cast("int") + 1)
                return F.transform(F.sequence(first, F.floor(p["i"] / stride).cast("int")), lambda k: F.struct(F.lit(w).alias("w"), (k * stride).cast("int").alias("at")))

            return F.flatten(F.transform(F.filter(at, lambda p: p["h"].isin(sorted(by_width[w]))), of))

        return F.array_distinct(F.concat(*map(around, sorted(by_width))))

    def retrieved(hashes: Column, at: Column) -> Column:
        signed = F.transform(windows(at), lambda x: F.filter(band_values(F.slice(hashes, x["at"] + 1, x["w"])), lambda v: v.isin(values)))
        return F.array_distinct(F.flatten(signed))

    def measured(words: Column) -> Column:
        def held(hashes: Column, at: Column) -> Column:
            own = F.transform(at, lambda p: F.struct(shingle_at(words, p["i"]).alias("s"), p["i"].alias("i")))
            return F.when(F.size(at) > 0, F.struct(retrieved(hashes, at).alias("values"), own.alias("own")))

        return let(shingle_hashes(words), lambda h: let(places(h), lambda at: held(h, at)))

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", let(normal_words(text_or_empty()), measured).alias("found"))
    met = rows.select("__row", "doc_id", "found.own", F.explode("found.values").alias("value")).join(F.broadcast(bands), "value")
    share = F.size(F.array_intersect(F.transform("own", lambda o: o["s"]), F.col("shingles"))) / F.size("shingles")
    first = F.array_min(F.transform(F.filter("own", lambda o: F.array_contains("shingles", o["s"])), lambda o: o["i"]))
    verified = met.select("__row", "doc_id", "license", "template", share.alias("containment"), first.alias("first_word")).where(F.col("containment") >= CONTAINMENT)
    best = F.max(F.struct("containment", (-F.col("template")).alias("t"), F.col("first_word").alias("f")))
    kept = verified.groupBy("__row", "doc_id", "license").agg(best.alias("best"))
    return kept.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.t")).alias("template"), F.col("best.f").cast("int").alias("first_word"))
