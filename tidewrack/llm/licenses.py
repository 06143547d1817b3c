"""License scans by diagonal voting, in DataFrame operations only.

Each text is lower-cased (A-Z) and cut into words. All rolling word 3-gram hashes are joined to the positions
of the same grams in the license templates; the gram's words are compared too, so every vote is exact.
Votes are summed by template and diagonal (document position minus template position). A diagonal that
holds every gram of a template is a verbatim place of it. Diagonals that lie within GAP of each other
(words inserted or left out) are merged, and the merged span is kept if it covers enough of the template's
grams. The templates are a fixed table of this module; a larger one given by the caller is joined by shuffle.

Edge cases: a null text is empty; a text shorter than a gram has no votes; no votes give 0 places, null
positions, empty labels and score 0; rows are told apart by id and text, so repeated rows give the same
result each and rows that share an id do not mix; equal shares of several templates give all their labels; a very long
text is cut into grams whole, one row for each gram that a template has; other columns, whatever their names, are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import ascii_lower

K, GAP, LEAST = 3, 2, 0.6
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Above this many grams the templates are not broadcast.
BROADCAST_GRAMS = 20_000
#: Phrases whose verbatim places are counted.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Opening words of public license notices; a text that only quotes these is told by them.
NOTICES: tuple[tuple[str, str], ...] = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Whole texts of public licenses, or the notices that they ask for.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
    including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
    WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
    CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
    copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
    ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
    anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
    Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""", "zlib"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
    OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache-2"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
    PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""", "gpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mpl-2"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
    binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
    software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
    perpetuity of all present and future rights to this software under copyright law.""", "unlicense"),
)
NOTICES += tuple((" ".join(re.findall(BREAK.replace("[", "[^", 1), text.lower())), label) for text, label in TEXTS)


def template_grams(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """(template, label, is_base, grams, t, w0, w1, w2): one row for each gram of each template."""
    rows = []
    for i, (phrase, label) in enumerate([*base, *notices]):
        w = phrase.split()
        rows += [(i, label, i < len(base), len(w) - K + 1, t, *w[t : t + K]) for t in range(len(w) - K + 1)]
    schema = "template int, label string, is_base boolean, grams int, t int, w0 string, w1 string, w2 string"
    grams = spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("w0", "w1", "w2"))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def votes(df: DataFrame, templates: DataFrame) -> DataFrame:
    """One row for each place where a gram of a document is a gram of a template."""
    cut = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("words"))
    gram = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - K + 1, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), w.alias("d0"), F.get("words", i + 1).alias("d1"), F.get("words", i + 2).alias("d2")),
    )
    grams = cut.select("doc_id", "text_hash", F.posexplode(gram).alias("pos", "g")).select("doc_id", "text_hash", "pos", "g.*")
    met = grams.join(templates, (grams["h"] == templates["h"]) & (F.col("d0") == F.col("w0")) & (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2")))
    return met.select("doc_id", "text_hash", "template", "label", "is_base", "grams", "t", "pos").distinct()


def spans(found: DataFrame) -> DataFrame:
    """Merged diagonals: (doc_id, text_hash, template, label, is_base, grams, covered, places, first_word, last_word).

    places, first_word and last_word speak of the diagonals that hold the whole template."""
    found = found.withColumn("diagonal", F.col("pos") - F.col("t"))
    whose = ["doc_id", "text_hash", "template", "label", "is_base", "grams"]
    lines = found.groupBy(*whose, "diagonal").agg(F.count("*").alias("n"), F.collect_set("t").alias("ts"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    lines = lines.withColumn("new", far.cast("int")).withColumn("merged", F.sum("new").over(order))
    whole = F.col("n") == F.col("grams")
    return lines.groupBy(*whose, "merged").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("covered"),
        F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
    )


def scan(df: DataFrame, base=BASE, notices=NOTICES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of (doc_id, text).

    score: the largest share of a template's grams that one span covers."""
    merged = spans(votes(df, template_grams(df.sparkSession, base, notices)))
    share = F.col("covered") / F.col("grams")
    verbatim = F.col("is_base") & (F.col("places") > 0)
    kept = verbatim | (~F.col("is_base") & (share >= least))
    found = merged.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).agg(
        F.sum(F.when(F.col("is_base"), F.col("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("last_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(verbatim, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",").alias("labels"),
        F.max(share).alias("score"),
    )
    rows = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["text_hash"] == found["th"]), "left")
    none = F.lit("")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    return ", ".join(f"({i}, '{p}', '{label}', {'true' if i < len(BASE) else 'false'})" for i, (p, label) in enumerate([*BASE, *NOTICES]))


ORACLE = f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), templates AS (
  SELECT template, label, is_base, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) - {K - 1} AS grams FROM (VALUES {_values()}) v(template, phrase, label, is_base)
), tgrams AS (
  SELECT template, label, is_base, grams, t, array_to_string(w[t + 1 : t + {K}], ' ') AS g FROM (SELECT *, unnest(range(grams)) AS t FROM templates)
), dgrams AS (
  SELECT r, pos, array_to_string(w[pos + 1 : pos + {K}], ' ') AS g FROM (SELECT r, w, unnest(range(greatest(len(w) - {K - 1}, 0))) AS pos FROM rows_)
), lines AS (
  SELECT r, template, label, is_base, grams, pos - t AS diagonal, count(*) AS n, list(DISTINCT t) AS ts
  FROM dgrams JOIN tgrams USING (g) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM lines
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS merged FROM marked
), merged_ AS (
  SELECT r, label, is_base, grams, merged, len(list_distinct(flatten(list(ts)))) AS covered, count(*) FILTER (n = grams) AS places,
         min(diagonal) FILTER (n = grams) AS first_word, max(diagonal) FILTER (n = grams) AS last_word
  FROM numbered GROUP BY r, template, label, is_base, grams, merged
), found AS (
  SELECT r, sum(places) FILTER (is_base) AS n_base, min(first_word) FILTER (is_base) AS first_word, max(last_word) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base AND places > 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((is_base AND places > 0) OR (NOT is_base AND covered / grams >= {LEAST})) AS labels,
         max(covered / grams) AS score
  FROM merged_ GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0) AS score
FROM rows_ LEFT JOIN found USING (r)
"""
