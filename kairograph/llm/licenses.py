"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-gram hashes of the documents are joined to the positions of the same hashes in license
templates.  A match at word p of a document and word t of a template votes for the diagonal p - t; votes
are counted by diagonal, neighbouring diagonals are merged (a word more or less shifts the rest), and a
span is verified by its words, by the share of the template's k-grams that it holds, and by its length.  The
score is that share, of the best span.  A fixed list of phrases is looked for beside it; a document in which
only a phrase stands scores PHRASE_SCORE.

Defined results: a null or blank text has no words and no labels; repeated rows get equal results; other
columns are ignored; an empty table gives no rows; ties between spans don't matter, since labels are a
set and the score is the largest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table
from .quality import let

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4
#: Diagonals so near are one place; least share of a template's k-grams; most words of a span over its template's.
NEAR, LEAST_SHARE, MOST_STRETCH = 3, 0.5, 1.5
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Score of a document in which only a phrase of the list stands.
PHRASE_SCORE = 0.5
#: Whole licenses, and notices that licenses ask for or that are in common use (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        'and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
)
#: Template positions up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(GAPS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def words(text: Column) -> Column:
    """Words after A-Z were lower-cased.  Spark's lower() may be used unless it makes ASCII letters of others (two code points do)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K")), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, GAPS), "")


def _stands_at(w: Column, parts: list[str]):
    def at(i: Column) -> Column:
        hit = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return hit

    return at


def base_places(w: Column) -> list[tuple[str, Column]]:
    """For each phrase its label and the start words of its places in ``w``."""
    out = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        there = F.array_contains(w, parts[0]) & F.array_contains(w, parts[-1])
        none = F.array().cast("array<int>")
        out.append((label, F.when(there, F.filter(F.sequence(F.lit(0), F.size(w) - 1), _stands_at(w, parts))).otherwise(none)))
    return out


def template_rows(spark, templates) -> DataFrame:
    rows = []
    for t, (label, text) in enumerate(templates):
        w = plain_words(text)
        rows += [(t, label, p, w[p : p + K], w[p], len(w), len(w) - K + 1) for p in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "template int, label string, t_pos int, gram array<string>, t_word string, t_words int, t_grams int")
    df = df.select("template", "label", "t_pos", F.xxhash64("gram").alias("t_hash"), "t_word", "t_words", "t_grams")
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified template places: doc_id, text_hash, label, first and last word, share of the template found."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def grams(w: Column) -> Column:
        return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.struct(F.xxhash64(F.slice(w, i, K)).alias("hash"), F.get(w, i - 1).alias("word"))))

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(let(words(text), grams)).alias("pos", "gram"))
    template = template_rows(docs.sparkSession, templates)
    # each word of a place but the last of its run is compared itself, beside the hash of the K from it on
    same = (each["gram.hash"] == template["t_hash"]) & (each["gram.word"] == template["t_word"])
    place = ["doc_id", "text_hash", "template"]
    votes = (
        each.join(template, same)
        .groupBy(*place, (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.first("label").alias("label"), F.first("t_words").alias("t_words"), F.first("t_grams").alias("t_grams"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("t_pos").alias("found"))
    )
    order = Window.partitionBy(*place).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    merged = (
        votes.withColumn("fresh", fresh)
        .withColumn("run", F.sum(F.col("fresh").cast("int")).over(order))
        .groupBy(*place, "run")
        .agg(F.first("label").alias("label"), F.first("t_words").alias("t_words"), F.first("t_grams").alias("t_grams"), F.min("low").alias("first_word"), (F.max("high") + K).alias("end_word"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"))
        .withColumn("share", F.col("n_found") / F.col("t_grams"))
    )
    good = (F.col("share") >= LEAST_SHARE) & (F.col("end_word") - F.col("first_word") <= MOST_STRETCH * F.col("t_words"))
    return merged.filter(good).select("doc_id", "text_hash", "label", "first_word", "end_word", "share")


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document: phrases, labels and score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        places = base_places(w)
        starts = F.concat(*[p for _, p in places])
        labels = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in places]))
        return F.struct(F.size(w).cast("long").alias("n_words"), starts.alias("starts"), labels.alias("base"))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), let(words(text), of_words).alias("w"))
    found = spans(docs, templates).groupBy(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash")).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    df = base.join(found, base["doc_id"].eqNullSafe(found["f_id"]) & (base["text_hash"] == found["f_hash"]), "left")
    none = F.array().cast("array<string>")
    return df.select(
        "doc_id",
        "w.n_words",
        F.size("w.starts").cast("long").alias("n_base"),
        F.array_min("w.starts").cast("long").alias("first_word"),
        F.array_max("w.starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("w.base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("w.base", F.coalesce("found", none))), ",").alias("labels"),
        F.least(F.coalesce("share", F.when(F.size("w.base") > 0, F.lit(PHRASE_SCORE)), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_licenses": op5_licenses}
ORACLE_SQL: dict[str, str] = {}
