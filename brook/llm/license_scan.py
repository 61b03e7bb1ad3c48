"""License scan: exact set-similarity join of text blocks with licence templates.

A block is a line of a text, or a run of as many consecutive words as the template has, wherever the lines break;
a template is a known notice with a label.  A block matches when it holds at least ``containment`` of the template's
words, or all of them if the template is short.  A match is placed at the line of its first shared word.  The join is exact:

* words are ordered by how many blocks of the whole corpus hold them, the rarest first;
* prefix filter: of a template with n words that needs r of them, a matching block holds one of the first
  n - r + 1 words in that order, so only blocks with a prefix word go on;
* length filter: a block needs r words at least;
* positional filter: if the first shared word is at place p (from 0), at most n - p words can be shared;
* what is left is verified by counting the shared words.

A run that matches holds a prefix word too, so runs are tried around the prefix words of the whole text only.

``license_scan`` reads each text once.  It notes which template words a document has, which gives the order (by how many
documents hold a word), and keeps the text of those that hold enough words of some template: a block can't have more
of them than its document.  The join then runs over these texts.

The counts and the index are as large as the templates, not the corpus, and everything else is expressions on
the rows.  Beside the join, fixed phrases are found as consecutive words of the whole text.

Defined cases: null and empty texts have no words and no labels; very long texts are scanned whole; rows that
share an id are scanned each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, doc_key, let, stored, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public licence notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
)
#: Templates of fewer words are met whole or not at all: one other word may be another licence.
SHORT = 10


def block_words(c: Column) -> Column:
    """The words of a text or block in order."""
    return F.filter(F.split(ascii_lower(c), SEPARATORS), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return sorted(set(template_run(text)))


def template_run(text: str) -> list[str]:
    """The words of a template in order."""
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _blocks(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    return docs.select(*keep, F.posexplode(F.split(text_of(text_col), "\n")).alias("block", "line"))


def word_frequency(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """How many blocks of all documents hold each template word: as many rows as the templates have words."""
    held = _blocks(docs, text_col).select(F.array_intersect(block_words(F.col("line")), _strings(vocabulary)).alias("ws"))
    return {r["w"]: r["n"] for r in held.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def needed(ws: Sequence[str], containment: float) -> int:
    """How many of a template's words a block must have."""
    return len(ws) if len(ws) < SHORT else ceil(containment * len(ws) - 1e-9)


def similarity_join(
    docs: DataFrame,
    id_columns: Sequence[str],
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = 0.8,
    text_col: str = "text",
    frequency: Mapping[str, int] | None = None,
) -> DataFrame:
    """Every (document, block, template) at or over the threshold: the id columns, block, template, label, shared, score.

    Rows of ``docs`` with the same id columns are told apart by their text only.  ``frequency`` orders the words; without
    it they are counted here.
    """
    spark = docs.sparkSession
    sets = [(k, label, template_words(text)) for k, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    seen = word_frequency(docs, vocabulary, text_col) if frequency is None else frequency
    index = []
    for k, label, ws in sets:
        ws = sorted(ws, key=lambda w: (seen.get(w, 0), w))
        need = needed(ws, containment)
        index += [(w, k, label, place, len(ws), need, ws) for place, w in enumerate(ws[: len(ws) - need + 1])]
    schema = "word string, template int, label string, place int, n int, need int, words array<string>"
    prefixes = sorted({x[0] for x in index})
    # as many rows as the templates have prefix words: bounded by the parameter
    lookup = F.broadcast(spark.createDataFrame(index, schema))
    some = F.col("line").rlike("(?i)" + "|".join(sorted({w for w in prefixes}, key=len))) if prefixes else F.lit(False)
    blocks = (
        _blocks(docs, text_col, *[F.col(c) for c in id_columns])
        .filter(some)
        .select(*id_columns, "block", F.array_distinct(block_words(F.col("line"))).alias("ws"))
        .withColumn("hit", F.array_intersect(F.col("ws"), _strings(prefixes)))
        .filter(F.size("hit") > 0)
    )
    candidates = (
        blocks.withColumn("word", F.explode("hit"))
        .drop("hit")
        .join(lookup, "word")
        .filter(F.size("ws") >= F.col("need"))
        .filter(F.col("n") - F.col("place") >= F.col("need"))
    )
    shared = F.size(F.array_intersect("ws", "words"))
    # a pair is met once for each shared prefix word: the first of them in the global order speaks for it
    first = F.array_min(F.transform(F.array_intersect("words", "ws"), lambda w: F.array_position("words", w)))
    lines = (
        candidates.filter(F.col("place") + 1 == first)
        .withColumn("shared", shared)
        .filter(F.col("shared") >= F.col("need"))
        .select(*id_columns, "block", "template", "label", "shared", "n")
    )
    lengths = {k: len(template_run(text)) for k, (_, text) in enumerate(templates)}
    found = lines.unionByName(_runs(docs, id_columns, lookup, lengths, prefixes, text_col)) if prefixes else lines
    # a line and a run, or several runs, may say the same
    one = found.groupBy(*id_columns, "block", "template", "label", "n").agg(F.max("shared").alias("shared"))
    return one.select(*id_columns, "block", "template", "label", "shared", (F.col("shared") / F.col("n")).alias("score"))


def _runs(docs: DataFrame, id_columns: Sequence[str], lookup: DataFrame, lengths: Mapping[int, int], prefixes: Sequence[str], text_col: str) -> DataFrame:
    """Matching runs of words that go over a line break."""
    most = max(lengths.values())
    text = text_of(text_col)
    some = F.contains(text, F.lit("\n")) & text.rlike("(?i)" + "|".join(sorted(prefixes, key=len)))
    line_words = F.transform(F.split(text, "\n"), lambda line, b: F.transform(block_words(line), lambda w: F.struct(w.alias("w"), b.alias("b"))))
    # around each prefix word, the words that a run with it may hold, if there is a line break among them
    words = let(
        F.flatten(line_words),
        lambda ws: F.filter(
            F.transform(
                F.filter(F.transform(ws, lambda x, i: F.struct(x["w"].alias("word"), i.alias("i"))), lambda x: x["word"].isin(list(prefixes))),
                lambda x: F.struct(
                    x["word"].alias("word"),
                    F.least(x["i"], F.lit(most - 1)).alias("at"),
                    F.slice(ws, F.greatest(x["i"] - most + 2, F.lit(1)), F.lit(2 * most - 1)).alias("near"),
                ),
            ),
            lambda x: F.element_at(x["near"], 1)["b"] < F.element_at(x["near"], -1)["b"],
        ),
    )
    hits = docs.filter(some).select(*id_columns, F.explode(words).alias("hit")).select(*id_columns, "hit.*")
    length = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("template"))
    near = (
        hits.join(lookup, "word")
        .withColumn("length", length)
        .withColumn("start", F.explode(F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)), F.col("at"))))
        .withColumn("run", F.slice("near", F.col("start") + 1, F.col("length")))
        .withColumn("own", F.filter("run", lambda x: F.array_contains("words", x["w"])))
        # a run starts at a word of the template; one within a line is a part of the line
        .filter((F.element_at("run", 1)["w"] == F.element_at("own", 1)["w"]) & (F.element_at("own", 1)["b"] < F.element_at("own", -1)["b"]))
        .withColumn("shared", F.size(F.array_distinct(F.col("own.w"))))
        .filter(F.col("shared") >= F.col("need"))
    )
    return near.select(*id_columns, F.element_at("own", 1)["b"].alias("block"), "template", "label", "shared", "n")


def _phrase_places(w: Column, phrases: Mapping[str, str]) -> Column:
    def starts(v: Column) -> Column:
        def label(word: Column, i: Column) -> Column:
            out = F.lit(None).cast("string")
            for phrase, name in phrases.items():
                first, *rest = phrase.split(" ")
                hit = word == first
                for k, x in enumerate(rest, 1):
                    hit = hit & (F.get(v, i + k) == x)
                out = F.when(hit, F.lit(name)).otherwise(out)
            return F.struct(i.alias("at"), out.alias("label"))

        return F.filter(F.transform(v, label), lambda x: x["label"].isNotNull())

    return let(w, starts)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    containment: float = 0.8,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks."""
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"), doc_key(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text")
    )
    sets = [template_words(text) for _, text in templates]
    vocabulary = sorted({w for ws in sets for w in ws})
    line = F.btrim(F.regexp_replace(ascii_lower(F.col("text")), SEPARATORS, " "), F.lit(" "))
    words = F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " "))
    # a phrase can only be there if its words are, side by side
    some = F.lit(False)
    for phrase in phrases:
        some = some | F.contains(F.col("line"), F.lit(phrase))
    enough = F.lit(False)
    for ws in sets:
        enough = enough | (F.size(F.array_intersect("held", _strings(ws))) >= needed(ws, containment))
    least = min((needed(ws, containment) for ws in sets), default=1)
    enough = (F.size("held") >= least) & enough
    scanned = stored(
        docs.sparkSession,
        keyed.withColumn("line", line)
        .withColumns({"ws": words, "some": some})
        .select("id", "did", "th", "text", F.size("ws").alias("n_words"), F.when(F.col("some"), _phrase_places(F.col("ws"), phrases)).alias("places"), F.array_intersect("ws", _strings(vocabulary)).alias("held"))
        .select("id", "did", "th", "n_words", "places", "held", F.when(enough, F.col("text")).alias("text")),
    )
    frequency = {r["w"]: r["n"] for r in scanned.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # template words
    base = scanned.select("id", "did", "th", "n_words", "places")
    found = (
        similarity_join(scanned.filter("text is not null").select("did", "th", "text"), ("did", "th"), templates, containment, frequency=frequency)
        .groupBy("did", "th")
        .agg(F.collect_set("label").alias("more"), F.max("score").alias("best"), F.count_distinct("block").alias("blocks"))
    )
    base_labels = F.coalesce(F.array_distinct(F.transform("places", lambda p: p["label"])), F.array().cast("array<string>"))
    return base.join(found, ["did", "th"], "left").select(
        F.col("id").alias(id_col),
        F.greatest(F.col("n_words"), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )
