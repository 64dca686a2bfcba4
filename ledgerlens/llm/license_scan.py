"""License scan: an exact set-similarity join of text blocks with license templates.

Templates are whole license texts and notices. Each is of a band by its number of words: band b holds
templates of more than 2**(b-1) and up to 2**b words. A band's blocks are windows of 2**(b+1) words, one
every 2**b words, over each whole document; so any passage of a template's length stands whole in a
block of its band, however its lines are wrapped, and a block is never more than four times as long as
its templates. A block meets a template when at least ``threshold`` of the template's distinct words are
in the block. The join is exact and has the usual filters, all over one order of words, rarest first,
counted over all documents:

* prefix: of a template of n words that needs m, one of the n - m + 1 rarest must be in the block;
* length: the block must hold at least m words of the template vocabulary;
* positional: from that word on, both sides must have m words left.

Survivors are verified by intersection. The first pass over the texts counts words; the second gives
blocks that hold a prefix word and enough words of the vocabulary for some template of their band. The
join is on band and word and broadcasts the templates' prefix index, whose size is fixed by the template
list and not by the data. Templates of fewer than ``LEAST_WORDS`` distinct words are refused: so few words
don't make a passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, needed, text_or_empty
from ledgerlens.llm.words import words_of
from ledgerlens.sources.tables import table

THRESHOLD, LEAST_WORDS = 0.9, 5

# The phrases that the contract names, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# License notices, with their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
# The whole texts of short licenses and the standard headers of long ones, with their labels.
TEXTS = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
        "boost",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
        "unlicense",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        "gpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl",
    ),
]
TEMPLATES = [*NOTICES, *TEXTS]


def phrase_places(words: list[bytes], phrases: list[bytes]) -> list[list[int]]:
    """For each phrase, the word numbers at which its words stand one after the other."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for p in phrases:
        places, at, n, seen = [], joined.find(b" " + p + b" "), 0, 0
        while at >= 0:
            n += joined.count(b" ", seen, at)
            seen = at
            places.append(n)
            at = joined.find(b" " + p + b" ", at + 1)
        out.append(places)
    return out


def band(n_words: int) -> int:
    """The band of a template of so many words: blocks are 2 ** (band + 1) words long."""
    return max(0, (n_words - 1).bit_length())


class Templates:
    """Templates as the join wants them. order: the vocabulary's words, rarest first, or None before
    they are counted."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, order: list[str] | None = None):
        self.rows = []
        cut = [(" ".join(w.decode() for w in words_of(t)), label) for t, label in templates]
        self.words = order or sorted({w for t, _ in cut for w in t.split()})
        self.rank = {w: r for r, w in enumerate(self.words)}
        for number, (t, label) in enumerate(cut):
            own = sorted(self.rank[w] for w in set(t.split()))
            if len(own) < LEAST_WORDS:
                raise ValueError(f"a template needs {LEAST_WORDS} distinct words at least: {t!r}")
            need = math.ceil(threshold * len(own) - 1e-9)
            self.rows.append((number, band(len(t.split())), need, own, own[: len(own) - need + 1], label))
        self.bands = {b: (min(r[2] for r in self.rows if r[1] == b), frozenset(w for r in self.rows if r[1] == b for w in r[4])) for b in sorted({r[1] for r in self.rows})}

    def blocks(self, words: list[bytes], rank: dict[bytes, int]) -> list[tuple[int, list[int]]]:
        """(band, ranks in order) of the blocks that may meet a template of their band."""
        at, ranks = [], []
        for i, r in enumerate(map(rank.get, words)):
            if r is not None:
                at.append(i)
                ranks.append(r)
        if not at:
            return []
        place, out = np.array(at), []
        for b, (least, prefix) in self.bands.items():
            leads = place[[r in prefix for r in ranks]]
            if not len(leads) or len(at) < least:
                continue
            step = 1 << b
            for s in np.unique(np.concatenate([leads // step, np.maximum(leads // step - 1, 0)])).tolist():
                low, high = np.searchsorted(place, [s * step, (s + 2) * step])
                if high - low >= least:
                    held = sorted(set(ranks[low:high]))
                    if len(held) >= least and not prefix.isdisjoint(held):
                        out.append((b, held))
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text"))


def counted(docs: DataFrame, templates: Templates) -> list[str]:
    """The vocabulary, rarest word of all documents first; ties by the word."""
    rank = {w.encode(): r for w, r in templates.rank.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(rank), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                found = [r for r in map(rank.get, words_of(text.as_py())) if r is not None]
                n += np.bincount(np.array(found, np.int64), minlength=len(n))
        yield pa.RecordBatch.from_pydict({"word": np.arange(len(n), dtype=np.int32), "n": n})

    total = dict(_texts(docs).select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    return [templates.words[r] for r in sorted(range(len(rank)), key=lambda r: (total.get(r, 0), templates.words[r]))]


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<struct<band:int,words:array<int>>>"
_BLOCK = pa.struct([("band", pa.int32()), ("words", pa.list_(pa.int32()))])


def _scan(docs: DataFrame, templates: Templates) -> DataFrame:
    """One row per document: what the phrases give, and the blocks that may meet a template."""
    rank = {w.encode(): r for w, r in templates.rank.items()}
    phrases, labels = [p.encode() for p, _ in PHRASES], [label for _, label in PHRASES]
    rare = [max(p.split(), key=len) if p != b"cc by" else b"cc" for p in phrases]
    texts = _texts(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = phrase_places(words, phrases) if any(r in words for r in rare) else [[] for _ in phrases]
                places = sorted(p for ps in found for p in ps)
                base = sorted({label for label, ps in zip(labels, found, strict=True) if ps})
                rows.append((len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), [{"band": b, "words": w} for b, w in templates.blocks(words, rank)]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(_BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    return texts.mapInArrow(scan, f"doc_id {dict(texts.dtypes)['doc_id']}, {SCAN}")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best containment of a template that is met, else 0).

    templates are (text, label); texts are taken as words like documents, so case and signs don't
    matter. Null and empty texts have no words and no labels. Null and repeated ids come back as they
    are, a row for each input row; an empty table gives no rows; further columns are ignored. Templates
    that several blocks meet count once; ties in frequency are broken by the word."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    known = Templates(templates, threshold, counted(docs, Templates(templates, threshold)))
    scanned = materialize(_scan(docs, known).withColumn("rid", F.monotonically_increasing_id()), "license-scan")
    prefixes = [(b, r, i, number, need, own, label) for number, b, need, own, prefix, label in known.rows for i, r in enumerate(prefix)]
    index = spark.createDataFrame(prefixes, "band int, rank int, t_pos int, template int, need int, t_words array<int>, label string")

    seeds = scanned.select("rid", F.explode("blocks").alias("b")).select("rid", "b.band", "b.words", F.posexplode("b.words").alias("pos", "rank"))
    met = (
        seeds.join(F.broadcast(index), ["band", "rank"])
        .where(F.size("words") >= F.col("need"))
        .where(F.least(F.size("t_words") - F.col("t_pos"), F.size("words") - F.col("pos")) >= F.col("need"))
        .withColumn("common", F.size(F.array_intersect("words", "t_words")))
        .where("common >= need")
        .groupBy("rid")
        .agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.size("t_words")).alias("score"))
    )
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    return scanned.drop("blocks").join(materialize(met, "license-met"), "rid", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"('{t}', '{label}', true, 0)" for t, label in PHRASES) + ", " + ", ".join(f"('{t}', '{label}', false, {1 << band(len(t.split()))})" for t, label in TEMPLATES)
    return rf"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered
), tpl AS (
  SELECT t, label, is_phrase, step, string_split(t, ' ') AS seq, list_distinct(string_split(t, ' ')) AS ws FROM (VALUES {values}) AS v(t, label, is_phrase, step)
), places AS (
  SELECT doc_id, label, u.i - 1 AS place
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) u, tpl
  WHERE is_phrase AND u.words[u.i] = seq[1] AND list_slice(u.words, u.i, u.i + len(seq) - 1) = seq
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_list FROM places GROUP BY doc_id
), steps AS (
  SELECT DISTINCT step FROM tpl WHERE NOT is_phrase
), blocks AS (
  SELECT doc_id, step, list_distinct(list_slice(words, s * step + 1, (s + 2) * step)) AS b
  FROM (SELECT doc_id, words, step, unnest(range(0, len(words) // step + 1)) AS s FROM w, steps)
), met AS (
  SELECT doc_id, label, len(list_intersect(b, ws)) / len(ws) AS c FROM blocks JOIN tpl USING (step) WHERE NOT is_phrase AND len(list_intersect(b, ws)) >= ceil({THRESHOLD} * len(ws) - 1e-9)
), found AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(c) AS score FROM met GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base_list, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(found, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL = _oracle()
