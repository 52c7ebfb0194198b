"""License scans as an exact set-similarity join, in DataFrame functions only.

Blocks are runs of words, wherever lines end: for each template, all runs a quarter longer
than it (so that foreign words may stand in between). Templates are a fixed list of notices,
whole ones and single sentences; blocks and templates are word sets. A block is found when
it holds at least ``threshold`` of a template's words; templates of fewer than ``whole_below``
words, in which one word makes another license, must be there whole.

Frequencies over all documents order the words of each template, rarest first, and so say which
of them make its prefix: so many that no block can hold enough words and none of them. Then

* prefix filter: only texts that hold a prefix word of a template are looked at for it, and in
  them only the runs near one, found through an index of the prefix words alone;
* length filter: a text must hold enough of a template's words;
* positional filter: around a prefix word, no more of the template can come than the words
  after the rarest one there, nor than the different ones that stand near;
* verification: a word at one place is new to the blocks that begin after its last occurrence,
  so a running sum over beginnings and ends counts the different words of every block in one
  sweep, whatever repeats.

All of it takes time in proportion to the text. Stretches of a long text are tasks of their own.

Defined results: null text is empty, and an empty text has no words; null ids are kept;
rows that repeat a document fare alike, each with a row of its own; a very long text is
read to its end; of equal shares the score is the same; other columns, whatever their
names, are ignored; an empty table gives an empty result. The Kelvin sign is no ``k``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._common import cut, small_enough

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places count, with their labels.
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))

#: Notices to look for, with their labels; the words of public license texts.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)

#: Words of each notice, with its label.
TEMPLATES = tuple((label, re.findall(r"[a-z0-9]+", text.lower())) for label, text in NOTICES)
#: Templates of fewer different words must be there whole, unless asked for otherwise.
WHOLE_BELOW = 15


def needed(n: int, threshold: float, whole_below: int = WHOLE_BELOW) -> int:
    """How many of the ``n`` different words of a template a block must hold."""
    return n if n < whole_below else math.ceil(threshold * n - 1e-9)


def run_length(n_words: int) -> int:
    """How many words the blocks for a template of ``n_words`` words have."""
    return n_words + n_words // 4


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters change as well, but none of them into another letter of the words looked for."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")))  # the Kelvin sign would become a k


def _places(words: Column, phrase: tuple[str, ...], lead: Column) -> Column:
    """Where the words of ``phrase`` stand one after another."""
    at = F.sequence(F.lit(0), F.size(words) - len(phrase))

    def begins(i: Column) -> Column:
        same = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            same &= F.get(words, i + k) == w
        return same

    found = F.transform(F.filter(at, begins), lambda i: i - lead)
    return F.when(F.size(words) >= len(phrase), found).otherwise(F.array().cast("array<int>"))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words): what stands between separators; the first and the last one may be empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.split(lowered(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN, -1).alias("words"))


def ranked(words: DataFrame, threshold: float = 0.8, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """(word, template, rank, size, need, run, label): words of templates, rarest in the documents first."""
    sets = [sorted(set(ws)) for _, ws in TEMPLATES]
    vocabulary = F.array(*map(F.lit, sorted({w for ws in sets for w in ws})))
    often = words.select(F.explode(F.array_intersect("words", vocabulary)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in often.collect()}  # at most one row per word of the templates
    rows = [
        f"('{w}', {t}, {i}, {len(ws)}, {needed(len(ws), threshold, whole_below)}, {run_length(len(TEMPLATES[t][1]))}, '{TEMPLATES[t][0]}')"
        for t, ws in enumerate(sets)
        for i, w in enumerate(sorted(ws, key=lambda w: (n.get(w, 0), w)))
    ]
    return words.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(word, template, rank, size, need, run, label)")


def in_prefix() -> Column:
    """Whether a word is among so many of the rarest that the others are fewer than needed."""
    return F.col("rank") <= F.col("size") - F.col("need")


def _scanned(words: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, n_words, places and labels of phrases, wanted, words), one row per input row.

    ``wanted``: numbers of the templates of which a prefix word and enough words are there;
    ``words`` only where there is one.
    """
    known: dict[int, list] = {}
    for r in index.sort("template", "rank").collect():  # a constant, however many documents there are
        known.setdefault(r["template"], []).append(r)
    sets = {t: ([r["word"] for r in own], [r["word"] for r in own[: own[0]["size"] - own[0]["need"] + 1]], own[0]["need"]) for t, own in known.items()}
    listed = lambda ws: F.array(*map(F.lit, ws))
    prefixes = listed(sorted({w for _, prefix, _ in sets.values() for w in prefix}))
    enough = [F.when(F.arrays_overlap("rare", listed(prefix)), F.when(F.size(F.array_intersect("words", listed(every))) >= need, F.lit(t))) for t, (every, prefix, need) in sets.items()]
    none = F.array().cast("array<int>")

    lead = (F.get("words", F.lit(0)) == "").cast("int")
    last = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    rows = words.select("doc_id", "words", lead.alias("lead"), (F.size("words") - lead - last).cast("long").alias("n_words"), F.array_intersect("words", prefixes).alias("rare"))
    named = [F.when(F.array_contains("words", phrase[-1]), _places(F.col("words"), phrase, F.col("lead"))).otherwise(none).alias(f"at_{label}") for label, phrase in PHRASES]
    rows = rows.select("doc_id", "n_words", "words", *named, F.when(F.size("rare") > 0, F.array_compact(F.array(*enough))).otherwise(none).alias("wanted"))
    starts = F.concat(*[F.col(f"at_{label}") for label, _ in PHRASES])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in PHRASES]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels.alias("named"),
        "wanted",
        F.when(F.size("wanted") > 0, F.col("words")).alias("words"),
    )


_STRETCH = ["row", "template", "stretch"]


def candidates(scanned: DataFrame, index: DataFrame, prefix: Column) -> DataFrame:
    """(row, template, stretch, rarest): where blocks may begin, in stretches of one run, from the index of prefix words."""
    words = scanned.filter(F.size("wanted") > 0).select("row", "wanted", F.posexplode("words").alias("place", "word"))
    rare = words.join(F.broadcast(index.filter(prefix)), "word").filter(F.array_contains("wanted", F.col("template")))
    at = F.floor(F.col("place") / F.col("run")).cast("int")
    # a block that holds the word begins in its own stretch or in the one before
    return rare.select("row", "template", "rank", F.explode(F.array(at - 1, at)).alias("stretch")).groupBy(*_STRETCH).agg(F.min("rank").alias("rarest"))


def bounded(scanned: DataFrame, index: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts`` with the hits in reach (two runs of words at most), of those that the positional bound leaves."""
    words = scanned.filter(F.size("wanted") > 0).select("row", "wanted", F.posexplode("words").alias("place", "word"))
    hits = words.join(F.broadcast(index), "word").filter(F.array_contains("wanted", F.col("template")))
    at = F.floor(F.col("place") / F.col("run")).cast("int")
    near = hits.select("row", "template", "place", "rank", "size", "need", "run", "label", F.explode(F.array(at - 1, at)).alias("stretch")).join(starts, _STRETCH)
    per = near.groupBy(*_STRETCH, "size", "need", "run", "label", "rarest").agg(F.size(F.collect_set("rank")).alias("different"), F.collect_list(F.struct("place", "rank")).alias("hits"))
    return per.filter(F.least("different", F.col("size") - F.col("rarest")) >= F.col("need")).drop("different", "rarest")


def verified(blocks: DataFrame) -> DataFrame:
    """(row, label, share): the most different words of any block that begins in a stretch, where they are enough."""
    each = blocks.select(*_STRETCH, "size", "need", "run", "label", F.inline("hits"))
    before = F.lag("place").over(Window.partitionBy(*_STRETCH, "rank").orderBy("place"))
    # the word at a place is new to the blocks that begin after its last one, reach it and do not begin after it
    opens = F.greatest(F.coalesce(before, F.col("place") - F.col("run")), F.col("place") - F.col("run")) + 1
    steps = each.select("*", opens.alias("opens")).select(*_STRETCH, "size", "need", "label", F.inline(F.array(F.struct(F.col("opens").alias("at"), F.lit(1).alias("step")), F.struct((F.col("place") + 1).alias("at"), F.lit(-1).alias("step")))))
    summed = steps.groupBy(*_STRETCH, "size", "need", "label", "at").agg(F.sum("step").alias("step"))
    held = F.sum("step").over(Window.partitionBy(*_STRETCH).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return summed.select("row", "label", "size", "need", held.alias("held")).filter(F.col("held") >= F.col("need")).groupBy("row", "label").agg(F.max(F.col("held") / F.col("size")).alias("share"))


def license_scan(docs: DataFrame, threshold: float = 0.8, whole_below: int = WHOLE_BELOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    ``score``: the largest share of a template found in a block, 1 where a phrase stands, else 0.
    """
    words = _words(docs, id_col, text_col)
    index = ranked(words, threshold, whole_below)
    scanned = cut(_scanned(words, index).withColumn("row", F.monotonically_increasing_id()))
    blocks = bounded(scanned, index, candidates(scanned, index, in_prefix()))
    found = cut(verified(blocks).groupBy(F.col("row").alias("found_row")).agg(F.collect_set("label").alias("found"), F.max("share").alias("share")))
    if small_enough(found, 128):
        found = F.broadcast(found)
    joined = scanned.drop("words", "wanted").join(found, F.col("row") == F.col("found_row"), "left")
    every = F.array_union("named", F.coalesce("found", F.array().cast("array<string>")))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("named"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"))


def oracle(threshold: float = 0.8, whole_below: int = WHOLE_BELOW) -> str:
    """The same rows by counting, for every word of a template in a text, the different ones in the run that begins there."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    notices = ", ".join(f"({t}, '{label}', {len(set(ws))}, {needed(len(set(ws)), threshold, whole_below)}, {run_length(len(ws))}, {sorted(set(ws))!r})" for t, (label, ws) in enumerate(TEMPLATES))
    starts = " UNION ALL ".join(
        f"SELECT k, i - 1 AS pos, '{label}' AS label FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')) WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(phrase))
        for label, phrase in PHRASES
    )
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
        s AS ({starts}),
        b AS (SELECT k, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM s GROUP BY k),
        t AS (SELECT t, label, size, need, run, unnest(ws) AS word FROM (VALUES {notices}) v(t, label, size, need, run, ws)),
        p AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        h AS (SELECT k, pos, t.* FROM p JOIN t USING (word)),
        e AS (SELECT k, t FROM h GROUP BY k, t HAVING count(DISTINCT word) >= any_value(need)),
        r AS (SELECT h.* FROM h SEMI JOIN e USING (k, t)),
        c AS (SELECT x.k, x.t, x.pos, any_value(x.label) AS label, any_value(x.size) AS size, any_value(x.need) AS need, count(DISTINCT y.word) AS n
              FROM r x JOIN r y ON x.k = y.k AND x.t = y.t AND y.pos >= x.pos AND y.pos < x.pos + x.run GROUP BY x.k, x.t, x.pos),
        f AS (SELECT k, list(DISTINCT label) AS labels, max(n / size) AS share FROM c WHERE n >= need GROUP BY k)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
               greatest(coalesce(f.share, 0), CASE WHEN b.n > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
        FROM d LEFT JOIN b USING (k) LEFT JOIN f USING (k)"""
