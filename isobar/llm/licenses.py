"""License scans: an exact set-similarity join of text blocks with license templates, built-in expressions only.

A template of L words is sought in blocks of 2 * step words, one every ``step`` words, where ``step`` is L rounded up to a
multiple of ``STRIDE``; so a copy at any place lies whole in some block, however long the template is. It matches a block
that contains at least ``containment`` of its n distinct words, that is ``need`` of them. The words of all phrases and
templates get ranks, the rarest in the corpus first; texts become arrays of ranks, 0 for all other words. Then

* prefix: a matching block holds one of the template's n - need + 1 rarest words, so blocks are found by an equi-join on
  those, each block at the first of them that it holds;
* length: the block has at least ``need`` words;
* position: in the order of ranks, the words of the block from that first common one on are at least ``need``, and so are
  those of the template (the prefix sees to that); no other word can take part;
* what is left is counted exactly.

Fixed phrases are found at the same time: words that stand consecutively anywhere in the text.

Nulls and empty texts have no words and no hits; very long texts are scanned whole, in blocks; an empty table gives an empty
result. Rows equal in id and text have equal results, and the input's columns ``keep`` (all if None) are in ``row``. The
templates are arguments, so their vocabulary, which the tasks hold, does not grow with the data.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import sequences
from isobar.session import materialize

#: Words of the shortest block, and what steps are multiples of.
BLOCK, STRIDE = 32, 16
CONTAINMENT = 0.8
#: Slots of the table that finds a word's rank, for each word.
SLOTS = 4

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: At the threshold, templates of up to four words need all of them, so licenses that differ in one word stay apart.
NOTICES = (
    ("under the mit license", "mit"),
    ("subject to the terms of the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("under the apache license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version", "mpl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons attribution license", "cc-by"),
    ("all rights reserved no part may be reproduced without permission", "proprietary"),
)

#: Paragraphs of public licenses, as published.
PARAGRAPHS = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program.",
        "gpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS "
        "IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
        "isc",
    ),
    (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
)

TEMPLATES = (*NOTICES, *PARAGRAPHS)


def words_of(template: str) -> list[str]:
    """The words of a template, as texts are cut."""
    low = template.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def step_of(words: list[str]) -> int:
    """Distance of the blocks in which a template is sought; a block is twice as long."""
    return max(1, -(-len(words) // STRIDE)) * STRIDE


def number_column(spark: SparkSession, numbers: dict[str, int]) -> Column:
    """The numbers of the words in the column ``words``, 0 for words without one.

    A word is looked up in a constant table of slots by its hash, so the cost does not depend on the vocabulary.
    """
    slots = max(1, SLOTS * len(numbers))
    held: list[list[str]] = [[] for _ in range(slots)]
    slot = F.pmod(F.xxhash64("word"), F.lit(slots))
    for r in spark.createDataFrame([(w,) for w in numbers], "word string").select("word", slot.alias("slot")).collect():
        held[r["slot"]].append(r["word"])
    # As JSON the tables are one constant each in the plan.
    table_words = F.from_json(F.lit(json.dumps(held)), "array<array<string>>")
    table_numbers = F.from_json(F.lit(json.dumps([[numbers[w] for w in own] for own in held])), "array<array<int>>")

    def of(word: Column) -> Column:
        at = F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")
        inner = F.array_position(table_words[at], word).cast("int")
        return F.when(inner > 0, table_numbers[at][inner - 1]).otherwise(0)

    return F.transform("words", of)


def word_ranks(documents: DataFrame, words: set[str]) -> dict[str, int]:
    """Ranks from 1 of the words, the rarest in the whole corpus first."""
    ordered = sorted(words)
    numbers = number_column(documents.sparkSession, {w: i + 1 for i, w in enumerate(ordered)})
    known = documents.select(F.filter(numbers, lambda x: x > 0).alias("numbers")).select(F.explode("numbers").alias("number"))
    count = {r["number"]: r["count"] for r in known.groupBy("number").count().collect()}  # one row a word of the vocabulary
    rarest = sorted(range(len(ordered)), key=lambda i: (count.get(i + 1, 0), ordered[i]))
    return {ordered[i]: place + 1 for place, i in enumerate(rarest)}


def patterns(spark: SparkSession, rank: dict[str, int], phrases, templates, containment: float) -> tuple[DataFrame, set[int]]:
    """(pattern_id, label, phrase, seq, anchor, at, need, step, shift): one row per anchor word of a phrase or template; and
    all anchors.

    Sequences are ranks: of a phrase in its own order, ``at`` the place of its rarest word; of a template ascending, ``at``
    the place of the anchor.
    """
    rows: list[tuple] = []
    for text, label in phrases:
        seq = [rank[w] for w in words_of(text)]
        if seq:
            at = seq.index(min(seq))
            rows.append((label, True, seq, seq[at], at, len(seq), STRIDE, 0))
    for text, label in templates:
        words = words_of(text)
        seq = sorted({rank[w] for w in words})
        need = math.ceil(containment * len(seq) - 1e-9)
        for at in range(len(seq) - need + 1 if seq else 0):
            rows += [(label, False, seq, seq[at], at, need, step_of(words), shift) for shift in (0, 1)]
    table = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "pattern_id long, label string, phrase boolean, seq array<int>, anchor int, at int, need int, step int, shift int",
    )
    return table, {r[3] for r in rows}


def scan_licenses(
    docs: DataFrame, doc_id: Column, text: Column, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, n_words, places, blocks).

    ``places`` lists (start, label) of the phrases; ``blocks`` lists (start, label, containment), the best per start and
    label. Both are empty lists for texts without any.
    """
    documents = sequences.word_arrays(docs, doc_id, text)
    spark = docs.sparkSession
    rank = word_ranks(documents, {w for t, _ in (*phrases, *templates) for w in words_of(t)})
    table, anchors = patterns(spark, rank, phrases, templates, containment)
    is_anchor = F.from_json(F.lit(json.dumps([r in anchors for r in range(len(rank) + 1)])), "array<boolean>")
    ranked = documents.select(*sequences.KEY, number_column(spark, rank).alias("words"))
    places = F.transform("words", lambda r, i: F.when(is_anchor[r], F.struct(i.alias("pos"), r.alias("word"))))
    ranked = ranked.withColumn("places", F.filter(places, lambda x: x.isNotNull()))

    begin = F.col("pos") - F.col("at")
    stands = (F.col("pos") >= F.col("at")) & (sequences.slice_at(F.col("words"), begin, F.size("seq")) == F.col("seq"))
    block = (F.floor(F.col("pos") / F.col("step")) - F.col("shift")) * F.col("step")
    length = F.least(F.col("step") * 2, F.size("words") - block)
    piece = sequences.slice_at(F.col("words"), block, F.col("step") * 2)
    first = ~F.arrays_overlap(piece, F.slice("seq", F.lit(1), F.col("at")))
    later = F.size(F.array_distinct(F.filter(piece, lambda r: r >= F.col("anchor"))))
    overlap = F.size(F.array_intersect(piece, F.col("seq")))
    holds = (block >= 0) & (length >= F.col("need")) & first & (later >= F.col("need")) & (overlap >= F.col("need"))
    met = sequences.match_anchors(ranked, table, F.when(F.col("phrase"), stands).otherwise(holds), places="places")
    hits = met.select(
        *sequences.KEY, "phrase", "label", F.when(F.col("phrase"), begin).otherwise(block).cast("long").alias("start"),
        F.when(F.col("phrase"), F.lit(1.0)).otherwise(overlap / F.size("seq")).alias("share"),
    )
    hits = materialize(hits, "license-hits").groupBy(*sequences.KEY, "phrase", "label", "start").agg(F.max("share").alias("share"))
    lists = hits.groupBy(*sequences.KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("phrase"), F.struct("start", "label")))).alias("places"),
        F.array_sort(F.collect_list(F.when(~F.col("phrase"), F.struct("start", "label", "share")))).alias("blocks"),
    )
    rows = sequences.kept_rows(docs, doc_id, text, keep)
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key"))
    none = {"places": "array<struct<start:bigint,label:string>>", "blocks": "array<struct<start:bigint,label:string,share:double>>"}
    return rows.alias("d").join(lists.alias("h"), same, "left").select(
        "d.row", "d.n_words", *[F.coalesce(F.col(f"h.{c}"), F.array().cast(t)).alias(c) for c, t in none.items()]
    )
