"""Operator 2: licence scans, with DataFrame functions alone.

A document's segments are its lines and its whole text. A segment is normalised to lower-case ASCII words and
compared with licence templates by the Dice coefficient of their sets of word bigrams,
2 |A n B| / (|A| + |B|). A coefficient of t or more needs t / (2 - t) |B| <= |A| <= (2 - t) / t |B|: segments
out of the range of all templates go before their bigrams are exploded, and pairs out of a template's range
before they are counted. Segments meet templates by a hash join on the bigram with the small template table.
A segment that matches a template lacks at most 1 - t / (2 - t) of its bigrams, so it holds at least one of any
larger share of them: of each template a few words are taken that lie in such a share, and texts and lines in which none
of these words occurs go before they are cut into words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize

#: Notices by which the licences ask to be named, as (SPDX identifier, text).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Texts of whole licences, for licence_passages; the placeholders of names are left out.
TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
#: Templates of so many bigrams in all at most are sent to every executor, and so many pairs of a text and a template.
BROADCAST_BIGRAMS = 200_000
BROADCAST_PAIRS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; only A-Z are lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def anchors(templates: DataFrame, num: int, den: int) -> list[str]:
    """Words of which every segment that matches one of the templates (template, w: its words) has one.

    Words are taken by what they cover of a template's bigrams, long words first, until a segment without
    them would lack too many. Templates are a small table; of a larger one there are no anchors."""
    taken: set[str] = set()
    rows = [r["w"] for r in templates.select("w").collect()]
    for w in sorted(rows, key=len):
        pairs = set(zip(w, w[1:]))
        lacking = len(pairs) - -(-len(pairs) * num // (2 * den - num))
        left = {p for p in pairs if not taken & set(p)}
        while len(pairs) - len(left) <= lacking:
            cover = {x: sum(x in p for p in left) for x in {x for p in left for x in p}}
            best = max(cover, key=lambda x: (cover[x] * len(x) ** 3, x))
            taken.add(best)
            left = {p for p in left if best not in p}
    return sorted(taken)


def holds_one(text: Column, words_: list[str]) -> Column:
    """Whether one of the words occurs in the text, in any case; a long one maybe within another word."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words_:
        if len(w) > 3:
            out = out | F.contains(low, F.lit(w))
    short = "|".join(w for w in words_ if len(w) <= 3)
    return out | F.rlike(text, F.lit(f"(?i)(?<![a-z0-9])(?:{short})(?![a-z0-9])")) if short else out


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(NOTICES)], "template int, licence string, text string")


def licence_matches(documents: DataFrame, templates: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, segment, licence, template, n_common, n_segment, n_template): for each segment the template of the
    largest Dice coefficient (then the smallest number), if it is num / den or more.

    segment 0 is the whole text, others are lines from 1 as \\n cuts them; a text of one line has only segment
    0. Segments and templates of fewer than two words match nothing; a null or empty text has none. A null
    doc_id is kept as it is; equal rows give equal matches, each once for every row; an empty table of
    documents or templates gives no rows; other columns are ignored. Templates: (template, licence, text).
    """
    t = templates.select("template", "licence", words(F.col("text")).alias("w")).withColumn("b", bigrams(F.col("w"))).where(F.size("b") > 0).withColumn("n_template", F.size("b"))
    least, most, total = t.agg(F.min("n_template"), F.max("n_template"), F.sum("n_template")).first()
    some = anchors(t, num, den) if 0 < (total or 0) <= BROADCAST_BIGRAMS else None
    able = (lambda x: holds_one(x, some)) if some is not None else (lambda x: F.lit(True))
    low, high = (least or 0) * num / (2 * den - num), (most or 0) * (2 * den - num) / num
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    lines = F.split("text", "\n")
    parts = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))
    segments = rows.where(F.col("text").isNotNull() & able(F.col("text"))).select("doc_id", "row", F.posexplode(parts).alias("segment", "part")).where(able(F.col("part")))
    # A segment of enough words can't be shorter than a fifth of its bigrams' number in bytes.
    named = segments.where(F.length("part") >= 2 * low).select("doc_id", "row", "segment", words(F.col("part")).alias("w")).where(F.size("w") - 1 >= low)
    sized = named.select("doc_id", "row", "segment", bigrams(F.col("w")).alias("b")).withColumn("n_segment", F.size("b")).where(F.col("n_segment").between(low, high))
    keyed = t.select("template", "licence", "n_template", F.explode("b").alias("bigram"))
    if (total or 0) <= BROADCAST_BIGRAMS:
        keyed = F.broadcast(keyed)
    met = sized.select("doc_id", "row", "segment", "n_segment", F.explode("b").alias("bigram")).join(keyed, "bigram")
    met = met.where((F.col("n_segment") * (2 * den - num) >= F.col("n_template") * num) & (F.col("n_segment") * num <= F.col("n_template") * (2 * den - num)))
    counted = met.groupBy("row", "segment", "template").agg(F.count("*").alias("n_common"), F.first("doc_id").alias("doc_id"), F.first("licence").alias("licence"), F.first("n_segment").alias("n_segment"), F.first("n_template").alias("n_template"))
    good = counted.where(2 * den * F.col("n_common") >= num * (F.col("n_segment") + F.col("n_template")))
    order = F.struct((F.col("n_common") / (F.col("n_segment") + F.col("n_template"))).alias("dice"), (-F.col("template")).alias("t"), "doc_id", "licence", "n_common", "n_segment", "n_template")
    best = good.groupBy("row", "segment").agg(F.max(order).alias("m"))
    return best.select("m.doc_id", F.col("segment").cast("int").alias("segment"), "m.licence", (-F.col("m.t")).cast("int").alias("template"), F.col("m.n_common").cast("bigint").alias("n_common"), F.col("m.n_segment").cast("bigint").alias("n_segment"), F.col("m.n_template").cast("bigint").alias("n_template"))


def passage_templates(spark: SparkSession) -> DataFrame:
    """The notices, and after them the texts of whole licences."""
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(NOTICES + TEXTS)], "template int, licence string, text string")


def licence_passages(documents: DataFrame, templates: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, first_word, licence, template, n_common, n_segment, n_template): passages anywhere in a text, over
    line ends or within a line, that a template matches with a Dice coefficient of num / den or more.

    A passage is a window of as many words as the template, which starts with a bigram of the template. Windows
    that could match are read from the left: of windows that overlap the last one kept, the one with more of the
    template's bigrams stays. Only texts that hold enough of a template's distinct bigrams at all are read so.
    first_word counts from 0. Templates match by themselves, so a notice within a longer one gives a row too.
    Nulls, repeated rows and empty tables are as in licence_matches."""
    few, all_ = num, 2 * den - num  # a match has few / all_ of the template's bigrams at least
    w = F.col("w")
    pairs = lambda x: F.when(F.size(x) > 1, F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    whole = templates.select("template", "licence", words(F.col("text")).alias("w")).where(F.size("w") > 1)
    t = whole.select("template", "licence", bigrams(w).alias("b"), (F.size("w") - 1).alias("span")).withColumn("n_template", F.size("b"))
    total, low = t.agg(F.sum("n_template"), F.min("n_template")).first()
    small = (total or 0) <= BROADCAST_BIGRAMS
    keyed = t.select("template", "n_template", F.explode("b").alias("bigram"))
    some = anchors(whole, num, den) if small and total else None
    rows = documents.where(F.col("text").isNotNull() & (holds_one(F.col("text"), some) if some is not None else F.lit(True))).select("doc_id", "text", F.xxhash64("text").alias("h"))
    sets = rows.select("h", F.monotonically_increasing_id().alias("row"), bigrams(words(F.col("text"))).alias("g")).where(F.size("g") * all_ >= (low or 0) * few)
    met = sets.select("h", "row", F.explode("g").alias("bigram")).join(F.broadcast(keyed) if small else keyed, "bigram")
    met = met.groupBy("row", "template").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.first("n_template").alias("n_template"))
    able = materialize(met.where(F.col("n") * all_ >= F.col("n_template") * few).select("h", "template").distinct(), "licence-pairs")
    able = F.broadcast(able) if able.count() <= BROADCAST_PAIRS else able
    read = rows.join(able, "h").join(F.broadcast(t) if small else t, "template").withColumn("g", pairs(words(F.col("text")))).drop("text")
    hits = F.filter(F.transform("g", lambda x, k: F.when(F.array_contains("b", x), k)), lambda k: k.isNotNull())
    read = read.withColumn("hits", hits)
    starts = F.expr(f"filter(transform(hits, (p, k) -> struct(p, size(filter(slice(hits, k + 1, span), q -> q < p + span)) as c)), x -> x.c * {all_} >= n_template * {few})")
    kept = F.expr("""aggregate(starts, cast(array() as array<struct<p:int,c:int>>), (acc, x) -> case
        when size(acc) = 0 or x.p > element_at(acc, -1).p + span then acc || array(x)
        when x.c > element_at(acc, -1).c then slice(acc, 1, size(acc) - 1) || array(x) else acc end)""")
    found = read.withColumn("starts", starts).withColumn("kept", kept).select("doc_id", "licence", "template", "n_template", "b", "g", "span", F.explode("kept").alias("s"))
    found = found.withColumn("a", F.expr("array_distinct(slice(g, s.p + 1, span))")).withColumn("n_segment", F.size("a")).withColumn("n_common", F.size(F.array_intersect("a", "b")))
    good = found.where(2 * den * F.col("n_common") >= num * (F.col("n_segment") + F.col("n_template")))
    return good.select("doc_id", F.col("s.p").cast("bigint").alias("first_word"), "licence", "template", *[F.col(c).cast("bigint").alias(c) for c in ("n_common", "n_segment", "n_template")])
