"""License scan: an exact set-similarity join of text blocks and license templates, in DataFrame expressions only.

Words are the runs of letters, digits and characters beyond ASCII, A-Z in lower
case. Base labels come from phrases whose words stand consecutively.

A block is a line of text (ended by a line feed), or two neighbouring lines,
as a license is often broken once. A block meets a template when it contains at
least ``threshold`` of the template's distinct words. A template that no line or
pair of lines of a text meets is looked for in windows of its words over three
lines or more, however they are broken: as many words as the template has, and
one for each line break (a comment mark). The join is exact:

* the templates' words are ordered by their frequency over all documents,
  rarest first (counted in full; the table has a row per template word);
* a block that meets a template T must hold one of T's first
  ``|T| - ceil(t |T|) + 1`` words: the prefix filter. Only blocks of texts with
  a prefix word are looked at;
* length filter: a block with fewer template words than ``ceil(t |T|)`` cannot meet it;
* positional filter: with their first common word at place i of T and j of the
  block's own template words, at most ``1 + min(|T| - i, |B| - j)`` (less one each)
  words can be common.

Templates and phrases are parameters of fixed size, so they travel in the plan:
no shuffle of texts, no skew. Null text has no words. A null or repeated doc_id keeps
its row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let
from .storage import small_batches

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences by which public licenses are usually declared, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = (90, 100)
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP, -1), "")


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def _starts(words: Column, n: Column, phrase: list[str]) -> Column:
    """Places of a phrase, by number of its first word."""

    def here(i: Column) -> Column:
        found = words[i] == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            found = found & (words[i + j] == w)
        return found

    last = n - F.lit(len(phrase))
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in all texts."""
    words = _words(F.translate("text", _UPPER, _LOWER))
    rows = docs.where("text IS NOT NULL").select(F.explode(F.filter(words, lambda w: w.isin(vocabulary))).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r.word: r["count"] for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of every row.

    matches: label, block (number of its first line), lines and containment of every block that meets a template, and of
    every window (from one of the template's words on) that meets a template which no block does; those have 3 lines or more.
    score: the greatest containment; 0 without a match.
    """
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("the threshold is above 0 and at most 1")
    small_batches(docs.sparkSession)
    sets = [(label, template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    count = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count[w], w)))}
    ordered = [(label, sorted(rank[w] for w in s), -(-num * len(s) // den)) for label, s in sets]
    lengths = [len(re.findall("[0-9a-z]+", text.lower())) for _, text in templates]
    names = sorted(vocabulary, key=rank.get)
    prefix = sorted({names[r] for _, ranks, need in ordered for r in ranks[: len(ranks) - need + 1]})

    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", _words(F.col("text")))
    df = df.withColumn("n", F.size("words"))
    places = []
    for phrase in PHRASES:
        parts = phrase.split()
        found = F.when(F.contains("text", F.lit(parts[0])) & F.contains("text", F.lit(parts[-1])), _starts(F.col("words"), F.col("n"), parts))
        places.append(F.coalesce(found, F.array().cast("array<int>")))
    df = df.select("doc_id", "text", "n", F.exists("words", lambda w: w.isin(prefix)).alias("candidate"), F.array(*places).alias("places"))

    known = F.array(*map(F.lit, names))

    def ranks_of(block: Column) -> Column:
        """Ranks of the block's distinct template words, in the global order."""
        own = F.array_intersect(known, _words(block))
        return F.sort_array(F.transform(own, lambda w: (F.array_position(known, w) - 1).cast("int")))

    def met(ranks: Column, lines: int, block: Column) -> Column:
        hits = []
        for no, (label, template, need) in enumerate(ordered):
            whole = F.array(*map(F.lit, template))
            head = F.array(*map(F.lit, template[: len(template) - need + 1]))
            first = lambda r, head=head: F.array_min(F.array_intersect(head, r))
            room = F.least(F.size(whole) - F.array_position(whole, first(ranks)), F.size(ranks) - F.array_position(ranks, first(ranks))) + 1
            common = F.size(F.array_intersect(whole, ranks))
            ok = (F.size(ranks) >= need) & F.arrays_overlap(head, ranks) & (room >= need) & (common >= need)
            hits.append(F.when(ok, F.struct(F.lit(label).alias("label"), block.alias("block"), F.lit(lines).alias("lines"), (common / F.lit(float(len(template)))).alias("containment"), F.lit(no).alias("template"))))
        return F.array_compact(F.array(*hits))

    def blocks(lines: Column) -> Column:
        one = F.transform(lines, lambda x: ranks_of(x))

        def joined(ranks: Column) -> Column:
            single = F.flatten(F.transform(ranks, lambda r, i: met(r, 1, i)))
            pairs = F.transform(F.sequence(F.lit(0), F.size(ranks) - 2), lambda i: met(F.sort_array(F.array_union(ranks[i], ranks[i + 1])), 2, i))
            both = let(F.concat(single, F.flatten(pairs)), lambda found: F.concat(found, windows(lines, F.array_distinct(F.flatten(ranks)), found)))
            return F.when(F.size(ranks) > 2, both).when(F.size(ranks) > 1, F.concat(single, F.flatten(pairs))).otherwise(single)

        return let(one, joined)

    def windows(lines: Column, have: Column, found: Column) -> Column:
        """Windows of three lines or more that meet a template which is not found; have: all ranks of the text."""
        met_already = F.transform(found, lambda m: m["template"])
        left = [(F.size(F.array_intersect(F.array(*map(F.lit, template)), have)) >= need) & ~F.array_contains(met_already, no) for no, (_, template, need) in enumerate(ordered)]
        full = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), _words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)
        words = F.flatten(F.transform(full, lambda x, row: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), row.alias("row"), w.alias("word")))))
        placed = F.filter(F.transform(words, lambda x, i: F.struct(x["line"].alias("line"), (i - x["row"]).alias("at"), x["word"].alias("word"))), lambda x: x["word"].isin(vocabulary))  # a word for each line is free

        def of(no: int, words: Column) -> Column:
            label, template, need = ordered[no]
            own = F.filter(words, lambda x: x["word"].isin([names[r] for r in template]))

            def starting(own: Column) -> Column:
                def window(x: Column, i: Column) -> Column:
                    return let(
                        F.filter(F.slice(own, i + 1, 2 * lengths[no]), lambda y: y["at"] < x["at"] + lengths[no]),
                        lambda w: F.struct(F.lit(label).alias("label"), x["line"].alias("block"), (F.element_at(w, -1)["line"] - x["line"] + 1).alias("lines"), (F.size(F.array_distinct(F.transform(w, lambda y: y["word"]))) / F.lit(float(len(template)))).alias("containment"), F.lit(no).alias("template")),
                    )

                return F.filter(F.transform(own, window), lambda m: (m["lines"] > 2) & (m["containment"] >= need / len(template)))

            return let(own, starting)

        some = left[0]
        for x in left[1:]:
            some = some | x
        every = lambda words: F.concat(*(F.when(left[no], of(no, words)).otherwise(none) for no in range(len(ordered))))
        return F.when(some, let(placed, every)).otherwise(none)

    none = F.array().cast("array<struct<label:string,block:int,lines:int,containment:double,template:int>>")
    df = df.withColumn("matches", F.when(F.col("candidate"), blocks(F.split("text", "\n", -1))).otherwise(none))
    df = df.withColumn("matches", F.transform("matches", lambda m: F.struct(*(m[c].alias(c) for c in ("label", "block", "lines", "containment")))))
    every = F.flatten("places")
    labels = F.array_compact(F.array(*(F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    base = F.array_sort(F.array_distinct(labels))
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
        "matches",
    )


def license_report(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("matches")
