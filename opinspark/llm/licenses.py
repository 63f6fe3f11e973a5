"""License scans by diagonal voting, in DataFrame functions alone.

Every rolling word 4-gram of every text is hashed and joined to the places where
license templates have it. A match at text place i and template place j votes for the diagonal i - j. Votes
are added up by diagonal, neighbouring diagonals (small insertions and losses) are merged, and a
merged span stands if it holds enough of the template's 4-grams. The words of a vote are compared as well as their hash.

Beside it, fixed phrases are counted at all their places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

GRAM = 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Texts and header notices of common licenses, as published (names of holders left out).
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"
        " of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
        " You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed"
        " under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
        " See the License for the specific language governing permissions and limitations under the License.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"
        " documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software,"
        " and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all"
        " subject to the following: The copyright notices in the Software and this entire statement, including the above license grant,"
        " this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all"
        " derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object"
        " code generated by a source language processor.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT"
        " NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL"
        " THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
        " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING"
        " NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "bsd-3-clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission.",
    ],
    "cc-by": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"
        " http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ],
    "cc-by-nc": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this"
        " license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ],
    "cc-by-sa": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this"
        " license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ],
    "cc0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software"
        " to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0"
        " Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is"
        " available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"
        " of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
        " You should have received a copy of the GNU General Public License along with this program.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
        " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
        " License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
        " This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to"
        " do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
        " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,"
        " or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,"
        " and by any means.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any"
        " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _phrase_starts(text: Column, words: Column) -> Column:
    """Sorted array of (start, label) of all places of all phrases."""
    low = lower_ascii(text)
    none = F.array().cast("array<struct<start:bigint,label:string>>")

    def places(parts: list[str], label: str) -> Column:
        n = len(parts)
        last = F.size(words) - n
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]))
        tagged = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
        there = _all([F.contains(low, F.lit(w)) for w in parts]) & (last >= 0)  # no phrase without its words
        return F.when(there, tagged).otherwise(none)

    return F.array_sort(F.concat(*[places(phrase.split(), label) for phrase, label in PHRASES.items()]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def template_grams(spark: SparkSession) -> DataFrame:
    """``label, template, total, place, words, gram``: every 4-gram of every template (a fixed table of some thousand rows)."""
    rows, number = [], 0
    for label, texts in TEMPLATES.items():
        for text in texts:
            words = re.findall(r"[0-9a-z]+", text.lower())
            total = len(words) - GRAM + 1
            rows += [(label, number, total, i, " ".join(words[i : i + GRAM])) for i in range(total)]
            number += 1
    table = spark.createDataFrame(rows, "label string, template int, total int, place int, words string")
    return table.withColumn("gram", F.xxhash64(*[F.split("words", " ")[k] for k in range(GRAM)]))


def _bits(grams: DataFrame) -> Column:
    """A set of hashes as an array of 64-bit words, to be looked up inside an expression; few other hashes pass."""
    word, bit = F.col("gram").bitwiseAND(F.lit(BITS // 64 - 1)), F.shiftrightunsigned("gram", 58)
    found = grams.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits")).collect()
    words = [0] * (BITS // 64)
    for row in found:  # a fixed number of rows
        words[row.word] = row.bits
    return F.from_json(F.lit(str(words)), "array<bigint>")


BITS = 1 << 18


def _hits(words: Column, bits: Column) -> Column:
    """(at, gram, words) of the rolling 4-grams that a template may have; all are hashed."""
    n = F.size(words)
    each = F.transform(
        F.sequence(F.lit(0), n - GRAM), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]).alias("gram"))
    )
    known = lambda x: F.getbit(F.get(bits, x["gram"].bitwiseAND(F.lit(BITS // 64 - 1)).cast("int")), F.shiftrightunsigned(x["gram"], 58).cast("int")) == 1
    named = F.transform(F.filter(each, known), lambda x: F.struct(x["at"], x["gram"], F.array_join(F.slice(words, x["at"] + 1, F.lit(GRAM)), " ").alias("words")))
    return F.when(n >= GRAM, named).otherwise(F.array().cast("array<struct<at:int,gram:bigint,words:string>>"))


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slack: int = 3, least: float = 0.6
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, places`` (sorted (start, label) of phrases) and ``spans``
    (template matches: label, first word, end exclusive, coverage).

    Every text is read and cut into words once; what leaves that pass are its phrases and the 4-grams that may be a template's. A vote
    counts where hash and words both agree. A span stands if the distinct template 4-grams on its merged diagonals (each at most
    ``slack`` from the next) are at least ``least`` of the template's. Spans are found per distinct text and joined back by its
    64-bit hash and length, so copies add no votes. Null and empty texts have no words; repeated rows get equal results; an
    empty table gives an empty one. Other columns are not looked at.
    """
    known = template_grams(docs.sparkSession)
    bits = _bits(known)
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("_hash"), F.octet_length(body).alias("_bytes"), body.alias("_text"), words_of(F.col(text)).alias("_words")
    )
    base = materialize(
        base.select(
            "doc_id",
            "_hash",
            "_bytes",
            F.size("_words").cast("long").alias("n_words"),
            _phrase_starts(F.col("_text"), F.col("_words")).alias("places"),
            _hits(F.col("_words"), bits).alias("hits"),
        )
    )
    grams = base.filter(F.size("hits") > 0).select("_hash", "_bytes", F.explode("hits").alias("h")).select("_hash", "_bytes", "h.*")
    same = ["_hash", "_bytes", "label", "template"]
    votes = (
        grams.join(F.broadcast(known), ["gram", "words"])  # a fixed table
        .select(*same, "total", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
        .groupBy(*same, "total", "diagonal")
        .agg(F.collect_set("place").alias("hit"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    in_turn = Window.partitionBy(*same).orderBy("diagonal")
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_turn) > slack).cast("int"), F.lit(0))
    merged = (
        votes.withColumn("_jump", jump)
        .withColumn("run", F.sum("_jump").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*same, "total", "run")
        .agg(F.flatten(F.collect_list("hit")).alias("hit"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("coverage", F.size(F.array_distinct("hit")) / F.col("total"))
        .filter(F.col("coverage") >= least)
    )
    span = F.struct("label", F.col("first").cast("long").alias("first"), (F.col("last") + GRAM).cast("long").alias("end"), "coverage")
    spans = merged.groupBy("_hash", "_bytes").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<label:string,first:bigint,end:bigint,coverage:double>>")
    return base.join(spans, ["_hash", "_bytes"], "left").select(
        "doc_id", "n_words", "places", F.coalesce("spans", none).alias("spans")
    )
