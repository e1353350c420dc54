"""License scan by an exact set-similarity join of text blocks with notices, in DataFrame functions only.

A text is cut into blocks of 2 * step words, one at each step, so that a notice of at most `step` words lies whole in one
block. A notice is found in a block that holds at least `percent` of the notice's distinct words. All words of notices are
put in one order, by their frequency in the corpus, rarest first. By the prefix filter such a block has one of the notice's
rarest words (all but need - 1 of them), so only blocks around those words are looked at; by the length filter it has
`need` words of notices at all; by the positional filter enough words follow, on both sides, the first word in common.
What passes is counted exactly, so no block that meets the threshold is lost and none is reported twice.

Places of whole phrases (base labels) are counted apart from that, by cutting the spaced words at the phrase.

Cases: a null or empty text has no words, no places and the score 0; a long text's blocks are made only around rare words;
rows that repeat are reported alike, each on its own; the labels of ties (a block that meets several notices) are all
given; a null doc_id stays; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import materialize


class Notice(NamedTuple):
    """A license's words, and those of them without which they are another license's."""

    label: str
    text: str
    must: tuple[str, ...] = ()


#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences by which licenses are known.
NOTICES = (
    Notice("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu", "general")),
    Notice("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general")),
    Notice("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("lesser",)),
    Notice("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("affero",)),
    Notice("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache",)),
    Notice("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Notice("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla",)),
    Notice("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", ("unencumbered",)),
    Notice("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived",)),
    Notice("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative", "commons")),
    Notice("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("commons", "sharealike")),
    Notice("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("commons", "noncommercial")),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
)
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PERCENT, STEP = 80, 64


def notice_words(notices: tuple[Notice, ...], step: int) -> list[frozenset[str]]:
    """The distinct words of each notice, which must not be longer than a step."""
    out = []
    for n in notices:
        found = [w for w in re.split(BETWEEN_WORDS, n.text.lower()) if w]
        if not found or len(found) > step or not set(n.must) <= set(found):
            raise ValueError(f"the notice of {n.label} needs 1 to {step} words, with those it must have")
        out.append(frozenset(found))
    return out


def needed(size: int, percent: int) -> int:
    """How many words of a notice of that size a block needs."""
    return max(1, -(-size * percent // 100))


def spaced(text: Column) -> Column:
    """A text's words in lower case, each between two single spaces."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), BETWEEN_WORDS, " ")


def spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(plain: Column, phrase: str, n_words: Column) -> Column:
    """How often a phrase's words stand in spaced words, and where its first and last place starts (null: nowhere)."""
    parts = F.split(plain, f"(?<= ){phrase}(?= )", -1)
    behind = F.lit(len(phrase.split()) - 1)
    first, last = spaces(F.get(parts, F.lit(0))) - 1, n_words - spaces(F.element_at(parts, -1)) - behind
    found = F.struct((F.size(parts) - 1).cast("long").alias("n"), first.alias("first"), last.alias("last"))
    return F.when(plain.contains(f" {phrase} "), found)


def word_order(rows: DataFrame, vocabulary: frozenset[str]) -> list[str]:
    """The notices' words, rarest first, by their count in all texts: as many rows as the notices have words."""
    used = rows.select(F.explode(F.filter("words", lambda w: w.isin(*sorted(vocabulary)))).alias("w")).groupBy("w").count().collect()
    counts = {r.w: r["count"] for r in used}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def blocks_around(words: Column, rare: list[str], vocabulary: frozenset[str], step: int) -> Column:
    """The blocks with a rare word: number, and the distinct words that notices have."""
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*rare), F.floor(i / step).cast("int"))), lambda k: k.isNotNull())
    numbers = F.array_distinct(F.flatten(F.transform(F.array_distinct(places), lambda k: F.array(F.greatest(k - 1, F.lit(0)), k))))
    known = lambda k: F.array_distinct(F.filter(F.slice(words, k * step + 1, F.lit(2 * step)), lambda w: w.isin(*sorted(vocabulary))))
    return F.transform(numbers, lambda k: F.struct(k.alias("block"), known(k).alias("known")))


def matching_blocks(blocks: DataFrame, notices: tuple[Notice, ...], sets: list[frozenset[str]], order: list[str], percent: int) -> DataFrame:
    """key, block, label, containment of (key, block, known): every block that meets a notice, once for each notice."""
    rank = {w: i for i, w in enumerate(order)}
    tables = []
    for no, (notice, words) in enumerate(zip(notices, sets)):
        mine, need = sorted(words, key=rank.__getitem__), needed(len(words), percent)
        tables += [(no, notice.label, mine, list(notice.must), need, i, mine[i]) for i in range(len(mine) - need + 1)]
    kind = "no int, label string, mine array<string>, must array<string>, need int, i int, word string"
    prefixes = F.broadcast(blocks.sparkSession.createDataFrame(tables, kind))
    ranked = blocks.select("key", "block", F.array_intersect(F.array(*map(F.lit, order)), "known").alias("ranked"))
    met = ranked.select("*", F.posexplode("ranked").alias("j", "word")).join(prefixes, "word")
    behind = F.least(F.size("mine") - F.col("i"), F.size("ranked") - F.col("j"))
    met = met.filter((F.size("ranked") >= F.col("need")) & (behind >= F.col("need"))).withColumn("common", F.array_intersect("ranked", "mine"))
    whole = (F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")) & (F.size(F.array_except("must", "common")) == 0)
    return met.filter(whole).select("key", "block", "label", (F.size("common") / F.size("mine")).alias("containment"))


def scan(docs: DataFrame, notices: tuple[Notice, ...], phrases: dict[str, str], percent: int, step: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their counts of words and places, each under a key of this run, and the blocks that meet a notice."""
    sets = notice_words(notices, step)
    vocabulary = frozenset().union(*sets)
    plain = docs.select("doc_id", spaced(F.col("text")).alias("plain"))
    listed = plain.withColumn("words", F.split(F.btrim("plain"), " "))
    order = word_order(listed, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    rare = sorted({w for s in sets for w in sorted(s, key=rank.__getitem__)[: len(s) - needed(len(s), percent) + 1]})
    n_words = F.when(F.col("plain") == " ", 0).otherwise(F.size("words")).cast("long")
    places = F.array(*(phrase_places(F.col("plain"), p, F.col("n_words")) for p in phrases))
    cut = listed.withColumn("n_words", n_words).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "n_words", places.alias("places"), blocks_around(F.col("words"), rare, vocabulary, step).alias("blocks"))
    rows = materialize(cut, "license-blocks")
    return rows, matching_blocks(rows.select("key", F.inline("blocks")), notices, sets, order, percent)


def license_blocks(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, percent: int = PERCENT, step: int = STEP) -> DataFrame:
    """doc_id, first_word, n_block_words, label, containment: every block that meets a notice."""
    rows, found = scan(docs, notices, PHRASES, percent, step)
    start = F.col("block").cast("long") * step
    joined = found.join(rows.select("key", "doc_id", "n_words"), "key")
    return joined.select("doc_id", start.alias("first_word"), F.least(F.col("n_words") - start, F.lit(2 * step)).alias("n_block_words"), "label", "containment")


def licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES, percent: int = PERCENT, step: int = STEP) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row. The score is 1 where a base
    phrase stands, else the highest share of a notice that a block holds, 0 without a block that meets one."""
    rows, found = scan(docs, notices, phrases, percent, step)
    by_row = found.groupBy("key").agg(F.collect_set("label").alias("by_notice"), F.max("containment").alias("best"))
    joined = rows.join(by_row, "key", "left")
    labelled = F.zip_with("places", F.array(*map(F.lit, phrases.values())), lambda p, label: F.when(p.isNotNull(), label))
    base = F.array_sort(F.array_distinct(F.array_compact(labelled)))
    met = F.array_compact("places")
    both = F.array_sort(F.array_union(base, F.coalesce("by_notice", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", F.aggregate(met, F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform(met, lambda p: p["first"])).alias("first_word"), F.array_max(F.transform(met, lambda p: p["last"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size(met) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
