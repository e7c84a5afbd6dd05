"""License scan: base phrases in place, and an exact set-similarity join of text blocks with license templates.

The tokens of the templates are ordered by their document frequency in the whole corpus, rarest first. With containment
threshold t a block must share at least a = ceil(t |T|) tokens with template T, hence at least one of the |T| - a + 1
rarest ones (prefix filter); it must hold at least a template tokens (length filter); and from the places of a shared
token in both ordered lists follows a bound on the overlap (position filter). Pairs that pass are verified on the whole
sets. A block is a window over the words of the whole text, whatever lines they stand on; windows overlap by half. A template
is met in windows of the smallest size that is at least twice its length, so wherever its words stand in a row, one window
holds them all. All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import ascii_lower

#: The phrases and labels of the base scan.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License wordings: lines that name a license, notices, and whole texts.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software you can redistribute it under the terms of the GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions"""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered
by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""),
)
#: The smallest window.
WINDOW = 64
#: Everything in ASCII that is neither a letter nor a digit separates words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def window_of(text: str) -> int:
    """Words of the windows in which a template is met: the smallest power of two of at least twice its length, WINDOW at least."""
    return max(WINDOW, 1 << (2 * len(listed(text)) - 1).bit_length())


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, BREAK), "")


def listed(text: str) -> list[str]:
    lowered = text.translate({k: k + 32 for k in range(65, 91)})
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in lowered).split()


def tokens(text: str) -> list[str]:
    return list(dict.fromkeys(listed(text)))


def _literal(items: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the phrase in the word array."""

    def here(word: Column, i: Column) -> Column:
        hit = word == phrase[0]
        for k, x in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == x, F.lit(False))
        return F.when(hit, i.cast("long"))

    return F.array_compact(F.transform(words, here))


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Null and empty texts have no words and no labels. score is 1 with a base phrase, else the best containment of a
    template at or above the threshold, else 0. Rows that repeat an id, and rows with a null id, have the labels of their own
    texts; an empty table gives no rows; other columns, whatever their names, are not read. Only the document frequencies of
    template tokens, some hundreds of numbers, reach the driver.
    """
    sets = [(label, tokens(text), window_of(text)) for label, text in templates]
    vocabulary = sorted({t for _, ts, _ in sets for t in ts})
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("low"))
    # labels found by the join belong to an id and a text
    split = rows.select("doc_id", F.md5("low").alias("digest"), words_of(F.col("low")).alias("words"))
    counted = split.select(F.explode(F.array_intersect(_literal(vocabulary), F.col("words"))).alias("token")).groupBy("token").count().collect()
    frequency = {r["token"]: r["count"] for r in counted}
    vocabulary.sort(key=lambda t: (frequency.get(t, 0), t))
    rank = {t: k for k, t in enumerate(vocabulary)}
    index, least = [], {}
    for k, (label, ts, span) in enumerate(sets):
        ts = sorted(ts, key=rank.__getitem__)
        need = math.ceil(threshold * len(ts) - 1e-9)
        least[span] = min(least.get(span, need), need)
        index += [(t, span, k, label, i, len(ts), need, ts) for i, t in enumerate(ts[: len(ts) - need + 1])]
    prefixes = sorted({row[0] for row in index})
    found = docs.sparkSession.createDataFrame(index, "token string, span int, template int, label string, i int, size int, need int, tokens array<string>")

    def windows(span: int) -> Column:
        """Blocks of one size: start, size, and the template tokens in order of frequency."""
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1 - span // 2, F.lit(0)), F.lit(span // 2))
        inside = lambda at: F.array_intersect(_literal(vocabulary), F.slice("words", at + 1, span))
        blocks = F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(span).alias("span"), inside(at).alias("block")))
        return F.filter(blocks, lambda b: F.size(b["block"]) >= least[span])

    likely = split.where(F.arrays_overlap("words", _literal(prefixes)))
    blocks = likely.select("doc_id", "digest", F.explode(F.concat(*map(windows, sorted(least)))).alias("b")).select("doc_id", "digest", "b.*")
    probes = blocks.select("*", F.posexplode("block").alias("j", "token"))
    bound = F.least("i", "j") + 1 + F.least(F.col("size") - 1 - F.col("i"), F.size("block") - 1 - F.col("j"))
    met = probes.join(F.broadcast(found), ["token", "span"]).where((F.size("block") >= F.col("need")) & (bound >= F.col("need")))  # the index has a few rows per template
    overlap = F.size(F.array_intersect("block", "tokens"))
    matches = met.withColumn("overlap", overlap).where("overlap >= need")
    by_doc = matches.groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("best"))

    words = F.col("words")
    n_base, firsts, lasts, named = F.lit(0), [], [], []
    for phrase, label in PHRASES:
        parts = phrase.split()
        there = F.when(F.array_contains(words, parts[0]) & F.array_contains(words, parts[1]), _places(words, parts))
        split = split.withColumn(f"at_{label}", F.coalesce(there, F.array().cast("array<bigint>")))
        at = F.col(f"at_{label}")
        n_base = n_base + F.size(at)
        firsts.append(F.array_min(at))
        lasts.append(F.array_max(at))
        named.append(F.when(F.size(at) > 0, F.lit(label)))
    base = split.select(
        "doc_id",
        "digest",
        F.size(words).cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*named))).alias("named"),
    )
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    joined = base.join(by_doc, base["doc_id"].eqNullSafe(by_doc["_id"]) & (base["digest"] == by_doc["_digest"]), "left")
    everything = F.array_sort(F.array_union("named", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(everything, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates: tuple = TEMPLATES, threshold: float = 0.9) -> str:
    """DuckDB SQL for the query's rows: every block against every template of its size."""
    rows = ", ".join("({}, '{}', {}, [{}])".format(k, label, window_of(text), ", ".join(f"'{t}'" for t in tokens(text))) for k, (label, text) in enumerate(templates))
    spans = ", ".join(f"({x})" for x in sorted({window_of(text) for _, text in templates}))
    split = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    at = []
    for phrase, _ in PHRASES:
        hit = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        at.append(f"list_filter(range(1, len(words) + 1), lambda i: coalesce({hit}, false))")
    named = ", ".join(f"CASE WHEN len(a{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    both = "list_concat(a0, list_concat(a1, a2))"
    return f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, {split.format("low")} AS words FROM n),
b AS (SELECT doc_id, len(words) AS n_words, {", ".join(f"{a} AS a{k}" for k, a in enumerate(at))} FROM w),
s(span) AS (VALUES {spans}),
k AS (SELECT doc_id, span, list_distinct(words[s + 1:s + span]) AS block FROM (SELECT doc_id, words, span, unnest(range(0, greatest(len(words) - span // 2, 1), span // 2)) AS s FROM w, s)),
t(id, label, span, tokens) AS (VALUES {rows}),
m AS (SELECT doc_id, label, len(list_intersect(block, tokens)) / len(tokens) AS share FROM k JOIN t USING (span) WHERE len(list_intersect(block, tokens)) >= ceil({threshold} * len(tokens) - 1e-9)),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM m GROUP BY doc_id),
r AS (SELECT b.*, list_filter([{named}], lambda x: x IS NOT NULL) AS base, more, best FROM b LEFT JOIN f ON f.doc_id = b.doc_id)
SELECT doc_id, n_words, len({both}) AS n_base, list_min({both}) - 1 AS first_word, list_max({both}) - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, CASE WHEN len({both}) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM r
"""
