"""License scans: lines, whole texts and passages against licence templates by the Dice coefficient of word bigrams.

DataFrame functions only. Text is lower-cased and everything but letters, digits and line ends becomes
one blank. With n distinct bigrams on one side and m on the other, Dice is at most 2 min(n, m) /
(n + m), so a template of m bigrams can only match units of t / (2 - t) * m to (2 - t) / t * m; units
meet their candidate templates by an equality join on n. The template table is fixed, so its broadcast is
of fixed size; documents are not shuffled. A bitmap over the bigrams of all templates comes first: a unit of n
bigrams needs at least t / (2 - t) * n of them there. Before all that, texts without any of the words that the templates
cannot do without are left out by plain searches of their bytes.

A passage is a copy of a template over line ends or inside a longer line. Bigrams that occur once in the template are anchors:
where one is found at word p and stands at word j of the template, the copy starts near p - j. Anchors sorted by that
offset fall into runs, one for each copy, however many copies there are; the words from a run's middle offset on are
measured exactly. So the work grows with the hits of a text and not with their pairs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8

# Texts of public licences and of the usual notices of them.
_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-mit": "Released under the MIT License.",
    "notice-gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "notice-cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "notice-bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "header-apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "header-gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _BSD
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "header-mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "header-agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General "
        "Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "header-lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
}


#: Parts of words, and whole words, of which every unit that matches a template holds at least one: without them it would lack
#: more than the third of the template's bigrams that it may lack. ``signs_suffice`` checks this for the templates in use.
SIGNS = (
    "author", "binary", "claim", "conditi", "contrib", "copyrig", "creativ", "damage", "dedicat", "distrib", "express", "govern", "implied", "includ", "liab", "licens", "merchant",
    "mozilla", "notice", "obtain", "particul", "permiss", "provide", "public", "publish", "purpose", "releas", "softwar", "source", "subject", "version", "warrant", "whether", "without",
)
SIGN_WORDS = ("cc",)


def signs_suffice(threshold: float = THRESHOLD) -> bool:
    """Whether every template keeps too few bigrams for a match if those with a sign are taken away."""
    for text in TEMPLATES.values():
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        pairs = set(zip(words, words[1:]))
        kept = sum(not any(w in SIGN_WORDS or any(s in w for s in SIGNS) for w in pair) for pair in pairs)
        if kept >= len(pairs) * (threshold / (2 - threshold)) - 1e-9:
            return False
    return True


def may_hold(text: Column) -> Column:
    """Whether a text holds a sign. A few searches over the bytes of the text, for texts that hold none."""
    low = F.lower(text)
    found = low.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(SIGN_WORDS) + r")(?![\p{L}\p{N}])")
    for sign in reversed(SIGNS):
        found = F.contains(low, F.lit(sign)) | found
    return found


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\n", " "), " "), lambda x: x != "")


def _pairs(words: Column) -> Column:
    """Hashes of the bigrams in their order."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.xxhash64(a, b))


@dataclass(frozen=True)
class Template:
    """Bigrams of a template in their order; ``distinct`` of them, and the sizes of unit that can match."""

    name: str
    bigrams: tuple[int, ...]
    distinct: int
    low: int
    high: int


def templates(spark: SparkSession, threshold: float = THRESHOLD) -> list[Template]:
    """The fixed templates, hashed as documents are."""
    rows = spark.createDataFrame(list(TEMPLATES.items()), "license_id string, text string").select("license_id", _pairs(_words(_normal(F.col("text")))).alias("b")).collect()
    found = []
    for r in rows:
        m = len(set(r.b))
        found.append(Template(r.license_id, tuple(r.b), m, math.ceil(m * (threshold / (2 - threshold)) - 1e-9), math.floor(m * ((2 - threshold) / threshold) + 1e-9)))
    return found


def _longs(values: list[int]) -> Column:
    """A constant array out of one literal: one of a thousand literals would slow every step of the planning."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


class Known:
    """Which bigrams occur in a template, as a bitmap over 16 bits of their hashes: at most one in a hundred others passes."""

    def __init__(self, known: list[Template]):
        words = [0] * 1024
        for t in known:
            for h in t.bigrams:
                words[(h >> 6) & 1023] |= 1 << (h & 63)
        self.words = _longs([w - (1 << 64) if w >> 63 else w for w in words])

    def has(self, h: Column) -> Column:
        return F.getbit(F.get(self.words, F.shiftright(h, 6).bitwiseAND(F.lit(1023)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def count(self, bigrams: Column) -> Column:
        return F.size(F.filter(bigrams, self.has))


def passages(rows: DataFrame, known: list[Template], threshold: float = THRESHOLD) -> DataFrame:
    """``rows``: doc_id, _lines (normal), _pairs, _spots (places of known bigrams) -> the columns of ``license_scans`` for passages.

    A passage that is one line reported by itself, or holds one, is left out, as is one that is more than four fifths of a text that is
    reported as a whole. Of passages of one template that overlap, the one of the higher Dice counts, then the earlier one.
    """
    anchors, others = [], []
    for t in known:
        for j, h in enumerate(t.bigrams):
            (anchors if t.bigrams.count(h) == 1 else others).append((h, t.name, j))
    offsets = {(h, name): j for h, name, j in anchors}
    table = [(t.name, [[h, offsets.get((h, t.name), -1)] for h in sorted(set(t.bigrams))], t.distinct, len(t.bigrams), max(2, len(t.bigrams) // 10), max(2, sum(t.bigrams.count(h) == 1 for h in t.bigrams) // 4), t.low) for t in known]
    frame = rows.sparkSession.createDataFrame(table, "license_id string, uses array<array<bigint>>, m int, long int, drift int, least int, need int")
    frame = frame.select("license_id", "m", "long", "drift", "least", "need", F.transform("uses", lambda u: u[0]).alias("pattern"), F.map_from_entries(F.transform("uses", lambda u: F.struct(u[0], u[1].cast("int")))).alias("place"))
    held = rows.select("doc_id", "_lines", "_pairs", F.transform("_spots", lambda i: F.struct(i.alias("p"), F.get("_pairs", i).alias("h"))).alias("_hits"))
    # Fixed templates, so the texts are joined to as many rows at most; only those of enough hits stay. No filter follows before the
    # last list is taken apart: it would be pushed down into the lists and be reckoned again for each of their elements. (A plain
    # explode would bring such a filter along, so the lists are taken apart with their empty ones.)
    near = held.join(F.broadcast(frame), F.size(F.array_intersect(F.transform("_hits", lambda x: x["h"]), F.col("pattern"))) >= F.col("need"))
    near = near.withColumn("_own", F.filter(F.transform("_hits", lambda x: F.struct(x["p"].alias("p"), F.try_element_at("place", x["h"]).alias("j"))), lambda x: x["j"].isNotNull())).drop("_hits", "place")
    near = near.withColumn("_off", F.sort_array(F.transform(F.filter("_own", lambda x: x["j"] >= 0), lambda x: x["p"] - x["j"])))
    # Runs of anchors whose offsets follow each other closely, as [first, last] of the sorted offsets.
    first = F.transform("_off", lambda o, k: F.when((k == 0) | (o - F.get("_off", k - 1) > F.col("drift")), k))
    near = near.withColumn("_first", F.filter(first, lambda k: k.isNotNull()))
    runs = F.transform("_first", lambda k, i: F.struct(k.alias("a"), (F.coalesce(F.get("_first", i + 1), F.size("_off")) - 1).alias("b")))
    near = near.withColumn("_starts", F.transform(F.filter(runs, lambda r: r["b"] - r["a"] + 1 >= F.col("least")), lambda r: F.get("_off", F.floor((r["a"] + r["b"]) / 2).cast("int")))).drop("_first", "_off", "_own")

    def dice(bigrams: Column) -> Column:
        return 2 * F.size(F.array_intersect(bigrams, F.col("pattern"))) / (F.size(F.array_distinct(bigrams)) + F.col("m"))

    def span(bigrams: Column, start: Column, stop: Column) -> Column:
        return F.slice(bigrams, start + 1, stop - start + 1)

    def cut(o: Column, i: Column, slack: Column) -> Column:
        """The hits of the words from offset ``o`` on, from the first to the last, with ``slack`` on both sides but for the neighbours' words."""
        low = F.greatest(o - slack, F.coalesce(F.get("_starts", i - 1) + F.col("long"), o - slack))
        high = F.least(o + F.col("long") - 1 + slack, F.coalesce(F.get("_starts", i + 1) - 1, o + F.col("long") - 1 + slack))
        low, high = F.greatest(F.least(low, o), F.lit(0)), F.greatest(high, o)
        words = F.slice("_pairs", low + 1, high - low + 1)
        inside = F.filter(F.transform(words, lambda h, k: F.when(F.array_contains("pattern", h), low + k)), lambda p: p.isNotNull())
        return F.struct(F.array_min(inside).alias("start"), F.array_max(inside).alias("stop"))

    def measured(x: Column) -> Column:
        bigrams = span(F.col("_pairs"), x["start"], x["stop"])
        return F.struct(dice(bigrams).alias("dice"), (-F.coalesce(x["stop"] - x["start"], F.lit(0))).alias("less"), x["start"].alias("start"), x["stop"].alias("stop"), F.size(F.array_intersect(bigrams, F.col("pattern"))).alias("overlap"))

    # The better of two cuts of each run, the shorter one where they are alike.
    near = near.withColumn("_cuts", F.transform("_starts", lambda o, i: F.array(cut(o, i, F.lit(0)), cut(o, i, F.col("drift")))))
    near = near.withColumn("_found", F.transform("_cuts", lambda pair: F.array_max(F.transform(F.filter(pair, lambda x: x["start"].isNotNull()), measured)))).drop("_cuts", "_starts")
    near = near.withColumn("_good", F.filter("_found", lambda x: x["dice"] >= threshold - 1e-12)).drop("_found")

    def beaten(x: Column, i: Column) -> Column:
        """Whether the run before or after overlaps and is better."""
        def by(k: Column, later: bool) -> Column:
            y = F.get("_good", k)
            apart = (y["start"] > x["stop"]) | (x["start"] > y["stop"])
            return F.coalesce(~apart & ((y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & F.lit(not later))), F.lit(False))
        return by(i - 1, False) | by(i + 1, True)

    near = near.withColumn("_best", F.filter("_good", lambda x, i: ~beaten(x, i))).drop("_good")
    near = near.withColumn("_at", F.flatten(F.transform("_lines", lambda x, i: F.array_repeat(i + 1, F.size(_words(x))))))
    whole = (F.size("_lines") > 1) & (dice(F.col("_pairs")) >= threshold - 1e-12)
    most = (F.col("x.stop") - F.col("x.start") + 1) * 5 > F.size("_pairs") * 4
    near = near.withColumn("_whole", whole).select("*", F.explode_outer("_best").alias("x")).where("x is not null").where(~(F.col("_whole") & most))
    touched = F.sequence(F.get("_at", F.col("x.start")), F.get("_at", F.col("x.stop") + 1))
    own = F.exists(touched, lambda i: dice(_pairs(_words(F.get("_lines", i - 1)))) >= threshold - 1e-12)
    return near.where(~own).select("doc_id", F.get("_at", F.col("x.start")).alias("line"), "license_id", F.col("x.overlap").alias("overlap"), F.col("x.dice").alias("dice"))


def license_scans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, line, license_id, overlap, dice: one row per unit and template that reach ``threshold``.

    ``line`` is the 1-based number of the line that matches, 0 for the text as a whole where it has several lines; for a
    passage over several lines or inside a longer one, the line on which it starts (see ``passages``). Null and
    empty texts match nothing; repeated rows give repeated matches, a null id is kept, ties between templates are all
    returned. Other columns are not read. A long text costs as much as its words and hits.
    """
    known = templates(docs.sparkSession, threshold)
    bitmap = Known(known)
    share = threshold / (2 - threshold)
    lines = F.split(_normal(F.col(text_col)), "\n", -1)
    if signs_suffice(threshold):
        docs = docs.where(may_hold(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("_lines")).where("_lines is not null")
    pairs = _pairs(_words(F.concat_ws(" ", "_lines")))
    # Only some texts hold as many known bigrams as the shortest template needs; their table is used twice, so it is written.
    rows = rows.where(bitmap.count(pairs) >= min(t.low for t in known)).withColumn("_pairs", pairs)
    spots = F.filter(F.transform("_pairs", lambda h, i: F.when(bitmap.has(h), i)), lambda i: i.isNotNull())
    rows = written(rows.withColumn("_spots", spots), "texts")
    whole = F.when(F.size("_lines") > 1, F.concat_ws("\n", "_lines"))
    units = rows.select("doc_id", F.posexplode(F.concat(F.array(whole), F.col("_lines"))).alias("line", "unit")).where("unit is not null")
    units = units.select("doc_id", "line", F.array_distinct(_pairs(_words(F.col("unit")))).alias("bigrams")).withColumn("n", F.size("bigrams")).where("n > 0")
    units = units.where(bitmap.count(F.col("bigrams")) >= share * F.col("n") - 1e-9)
    # Both tables are fixed by TEMPLATES.
    sizes = docs.sparkSession.createDataFrame([(n, t.name) for t in known for n in range(t.low, t.high + 1)], "n int, license_id string")
    patterns = docs.sparkSession.createDataFrame([(t.name, sorted(set(t.bigrams)), t.distinct) for t in known], "license_id string, pattern array<bigint>, m int")
    found = units.join(F.broadcast(sizes), "n").join(F.broadcast(patterns), "license_id").withColumn("overlap", F.size(F.array_intersect("bigrams", "pattern")))
    found = found.withColumn("dice", 2 * F.col("overlap") / (F.col("n") + F.col("m"))).where(F.col("dice") >= threshold - 1e-12)
    return found.select("doc_id", "line", "license_id", "overlap", "dice").union(passages(rows, known, threshold))
