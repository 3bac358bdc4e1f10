"""License notices by diagonal voting.

Every rolling k-gram of words of every text is hashed. Grams that occur in a template pass (the
template table has a few hundred rows, so the semi-join with it runs inside the hashing scan), are
joined with all template positions they occur at, and vote for the diagonal
``position in text - position in template``. Neighbouring diagonals merge, so that inserted and left
out words do not split a notice; spans with enough votes are verified by aligning their words with the template's.

A gram votes with a weight that is divided by the number of labels whose templates have it, and a span needs
``MIN_OWN`` of the grams that only its label has: openings that licences share say nothing. Where verified spans of
several labels overlap, the label of the most similar one is kept (then the longest, then by name).

Base phrases are counted at every place. A null text is empty; texts shorter than a phrase or a
gram have no places. Equal texts are scanned for spans once, all rows get the result; rows with a null id too.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, combined, join_facts, lowered, only, raw, signed, slices, staged, text_of

GRAM = 3
MAX_SHIFT = 4
MIN_VOTES, MIN_OWN, MIN_SIMILARITY = 0.4, 0.5, 0.7
#: weight of a gram, divided by the number of labels that share it
WEIGHT = 2520
#: Phrases and the labels they stand for.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Common notices, paragraph by paragraph.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "This work is licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(lowered(data), np.array([0, len(data)]), NOT_ALNUM).hashes


def grams_of(text: str) -> list[int]:
    h = word_hashes(text)
    return signed(combined(h, np.arange(len(h) - GRAM + 1), GRAM)).tolist()


def template_positions(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, gram, at, n_grams, weight, own, needed, n_own: one row per position of every template."""
    grams = [grams_of(text) for _, text in templates]
    labels: dict[int, set[str]] = {}
    for (label, _), found in zip(templates, grams):
        for g in found:
            labels.setdefault(g, set()).add(label)
    rows = []
    for i, ((label, _), found) in enumerate(zip(templates, grams)):
        weights, own = [WEIGHT // len(labels[g]) for g in found], [int(len(labels[g]) == 1) for g in found]
        rows += [(i, label, g, at, len(found), weights[at], own[at], MIN_VOTES * sum(weights), sum(own)) for at, g in enumerate(found)]
    return spark.createDataFrame(rows, "template int, label string, gram bigint, at int, n_grams int, weight int, own int, needed double, n_own int")


def scan_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per text: word count, base places, gram hits, and the word hashes from the first hit to the last."""
    phrases = [(word_hashes(p), label) for p, label in PHRASES]
    grams = np.unique(np.concatenate([combined(h, np.arange(len(h) - GRAM + 1), GRAM) for h in (word_hashes(t) for _, t in templates)]))
    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", text_of("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit_type = pa.list_(pa.struct([("pos", pa.int32()), ("gram", pa.int64())]))
        for part in slices(batches):
            data, offsets = raw(part.column(1))
            words = Words(lowered(data), offsets, NOT_ALNUM)
            n, h = part.num_rows, words.hashes
            places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for phrase, label in phrases:
                m = len(phrase)
                at = np.flatnonzero(h[: max(0, len(h) - m + 1)] == phrase[0])
                for j in range(1, m):
                    at = at[h[at + j] == phrase[j]]
                for i in at[words.text[at] == words.text[at + m - 1]].tolist():
                    t = words.text[i]
                    places[t].append((i - int(words.bounds[t]), label))
            first, windows = words.windows(GRAM)
            i = np.minimum(np.searchsorted(grams, windows), len(grams) - 1)
            at = first[grams[i] == windows]
            values = signed(windows[grams[i] == windows])
            of = np.searchsorted(words.text[at], np.arange(n + 1))
            hits, spans, begins = [], [], []
            raw_bytes, ends = data.tobytes(), offsets.tolist()
            for t in range(n):
                a, b = of[t], of[t + 1]
                base = int(words.bounds[t])
                hits.append([{"pos": int(p) - base, "gram": int(g)} for p, g in zip(at[a:b], values[a:b])])
                spans.append(signed(h[at[a]: at[b - 1] + GRAM]).tolist() if b > a else [])
                begins.append(int(at[a]) - base if b > a else 0)
            keys = [hashlib.md5(raw_bytes[ends[t]: ends[t + 1]]).hexdigest() for t in range(n)]
            starts = [[p for p, _ in x] for x in places]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(keys, pa.string()), pa.array(words.counts.astype(np.int64)), pa.array([len(x) for x in starts], pa.int64()),
                pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64()),
                pa.array([sorted({label for _, label in x}) for x in places], pa.list_(pa.string())), pa.array(hits, hit_type), pa.array(spans, pa.list_(pa.int64())), pa.array(begins, pa.int32()),
            ], ["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base", "hits", "words", "words_at"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, hits array<struct<pos:int,gram:bigint>>, words array<bigint>, words_at int")


def notices(scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    """text_key, label, start, stop, similarity of the verified notices."""
    spark = scanned.sparkSession
    texts = scanned.filter(F.size("hits") > 0).select("text_key", "hits", "words", "words_at").dropDuplicates(["text_key"])
    hits = texts.select("text_key", F.explode("hits").alias("hit")).select("text_key", "hit.pos", "hit.gram")
    votes = (
        hits.join(F.broadcast(template_positions(spark, templates)), "gram")  # a fixed table of a few hundred rows
        .groupBy("text_key", "template", "label", "n_grams", "needed", "n_own", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.sum("weight").alias("votes"), F.sum("own").alias("own"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    )
    by_template = Window.partitionBy("text_key", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_template) > MAX_SHIFT).cast("int"), F.lit(1))
    merged = (
        votes.withColumn("opens", opens).withColumn("group", F.sum("opens").over(by_template))
        .groupBy("text_key", "template", "label", "n_grams", "needed", "n_own", "group")
        .agg(F.sum("votes").alias("votes"), F.sum("own").alias("own"), F.min("start").alias("start"), (F.max("last") + GRAM).alias("stop"))
        .filter((F.col("votes") >= F.col("needed")) & (F.col("own") >= F.greatest(MIN_OWN * F.col("n_own"), F.lit(1))) & (F.col("stop") - F.col("start") <= 3 * (F.col("n_grams") + GRAM)))
    )
    cut = merged.join(texts.select("text_key", "words", "words_at"), "text_key").select(
        "text_key", "template", "label", "start", "stop", F.slice("words", F.col("start") - F.col("words_at") + 1, F.col("stop") - F.col("start")).alias("words")
    )
    known = [signed(word_hashes(t)).tolist() for _, t in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names = part.schema.names
            similar = [difflib.SequenceMatcher(None, known[t], w, autojunk=False).ratio() for t, w in zip(part.column(names.index("template")).to_pylist(), part.column(names.index("words")).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(names.index(c)) for c in ("text_key", "label", "start", "stop")] + [pa.array(similar, pa.float64())], ["text_key", "label", "start", "stop", "similarity"])

    return best_of_place(cut.mapInArrow(verify, "text_key string, label string, start int, stop int, similarity double").filter(F.col("similarity") >= MIN_SIMILARITY))


def best_of_place(spans: DataFrame) -> DataFrame:
    """The spans of the best label of every place, a place being a run of overlapping spans."""
    along = Window.partitionBy("text_key").orderBy("start", "stop", "label")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    places = spans.withColumn("_opens", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("_place", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("text_key", "_place").orderBy(F.desc("similarity"), F.desc(F.col("stop") - F.col("start")), "label").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return places.withColumn("_best", F.first("label").over(best)).filter(F.col("label") == F.col("_best")).select(*spans.columns)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row."""
    scanned = staged(scan_words(docs, doc_id, text, templates))
    found = notices(scanned, templates).groupBy("text_key").agg(F.max("similarity").alias("best"), F.sort_array(F.collect_set(F.struct("start", "stop", "label"))).alias("spans"))
    met = join_facts(scanned.drop("hits", "words", "words_at"), found, ["text_key"])
    every = F.array_sort(F.array_union("base", F.coalesce(F.col("spans.label"), F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.round("best", 6), F.lit(0.0)))
    return met.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int,label:string>>")).alias("spans"))
