"""License scan: exact set-similarity join of text blocks with license templates.

The blocks of a template are all runs of as many words as the template has, plus a margin; line ends play no part, so a
wrapped notice is found and scattered words are not. A block meets a template when it holds at least ``threshold`` of the
template's distinct words. Words are ordered by how many documents hold them, rarest first. A template that needs k of its m words
can only be met by a block that holds one of its m - k + 1 rarest words (prefix filter), has k words of the
template vocabulary (length filter), and has enough words left behind the first common one (positional
filter). The filters look at all words around a prefix word that can share a block with it; what is left is compared
exactly, block by block. The prefix index is as large as the templates, whatever the
corpus, so every document looks it up in its own row: no text is shuffled and a common word costs nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.expr import let
from docspark.llm.common import NOT_ALNUM, lower_ascii, words

#: Phrases whose words stand consecutively, and their labels (fixed values).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: License notices and their labels (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
THRESHOLD = 0.9
#: So many other words may stand between those of a notice (line markers, names).
MARGIN = 10


def template_sequence(text: str) -> list[str]:
    """Words of a template, by the same rule as those of documents."""
    low = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text)
    return low.split()


def template_words(text: str) -> list[str]:
    """Distinct words of a template."""
    return list(dict.fromkeys(template_sequence(text)))


def word_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How many documents hold each word of the template vocabulary; at most one entry per vocabulary word."""
    held = F.array_intersect(words(lower_ascii(F.col(text_col)), NOT_ALNUM), F.array(*[F.lit(w) for w in vocabulary]))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in counts}


def phrase_starts(tokens: Column, phrase: str) -> Column:
    """Positions (from 0) at which the phrase's words stand consecutively."""
    parts = phrase.split()
    here = lambda i: [F.get(tokens, i + k) == F.lit(p) for k, p in enumerate(parts)]
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.coalesce(_all(here(i)), F.lit(False)))
    return F.when(F.array_contains(tokens, parts[-1]), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


class Index:
    """Prefix index over the templates under a global word order."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float, margin: int = MARGIN):
        vocabulary = sorted({w for _, t in templates for w in template_words(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.entries: dict[int, list[tuple]] = {}
        for label, text in templates:
            ranks = sorted(self.rank[w] for w in template_words(text))
            need = math.ceil(threshold * len(ranks) - 1e-9)
            for at, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.entries.setdefault(r, []).append((label, ranks, need, at, len(template_sequence(text)) + margin))

    def places(self, tokens: Column) -> Column:
        """``(at, rank)`` of the tokens that occur in a template at all, in order."""
        known = F.create_map(*[x for w, r in self.rank.items() for x in (F.lit(w), F.lit(r))])
        numbered = F.filter(F.transform(tokens, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(list(self.rank)))
        return F.transform(numbered, lambda x: F.struct(x["at"].alias("at"), F.element_at(known, x["word"]).alias("rank")))

    def prefix_words(self) -> list[str]:
        return [w for w, r in self.rank.items() if r in self.entries]

    def matches(self, places: Column) -> Column:
        """(label, containment) of every template met by a text given as places; for each prefix word in it the best block around."""
        numbers = F.sequence(F.lit(0), F.size(places) - 1)

        def found(r: int, label: str, *entry) -> Column:
            here = F.filter(numbers, lambda i: F.get(places, i)["rank"] == r)
            best = F.array_max(F.transform(here, lambda i: self.share(places, i, r, *entry)))
            return let(best, lambda x: F.when(x.isNotNull(), F.struct(F.lit(label).alias("label"), x.alias("share"))))

        all_found = F.array(*[found(r, *entry) for r, entries in self.entries.items() for entry in entries])
        return F.when(F.size(places) > 0, F.array_compact(all_found))

    @staticmethod
    def share(places: Column, i: Column, r: int, members: list[int], need: int, at: int, span: int) -> Column:
        """The largest containment among blocks near place ``i``, whose rank is ``r``; null if none meets the template."""
        center = F.get(places, i)["at"]
        begin = F.greatest(i - span + 2, F.lit(1))  # each place takes a word, so nearer words are nearer in the list
        around = F.filter(F.slice(places, begin, F.lit(2 * span - 1)), lambda x: F.abs(x["at"] - center) < span)

        def blocks(near: Column) -> Column:
            inside = lambda x: F.filter(near, lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + span))
            overlap = F.array_max(F.transform(near, lambda x: F.size(F.array_distinct(inside(x)["rank"]))))
            return F.when(overlap >= need, overlap / F.lit(float(len(members))))

        def met(near: Column) -> Column:
            ranks = F.sort_array(F.array_distinct(near["rank"]))

            def passes(ranks: Column) -> Column:
                position = F.array_position(ranks, F.lit(r)) - 1
                bound = 1 + F.least(F.lit(len(members) - at - 1), F.size(ranks) - position - 1)
                # first common word: none of the template's rarer words may be here, or a longer overlap is possible
                bound = bound + sum((F.array_contains(ranks, F.lit(m)).cast("int") for m in members[:at]), F.lit(0))
                return (F.size(ranks) >= need) & (bound >= need)

            own = F.filter(near, lambda x: x["rank"].isin(members))
            return F.when(let(ranks, passes), let(own, blocks))

        return let(around, met)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
                  threshold: float = THRESHOLD, margin: int = MARGIN) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, matches, labels, score`` of every row.

    ``n_base`` counts the places of the fixed phrases, ``first_word`` and ``last_word`` are the smallest and largest
    of their starts. ``matches`` lists (label, containment) of the blocks that meet a template, the best around each prefix word. ``labels`` joins the
    labels of both; ``score`` is 1 with a base label, else the largest containment, else 0. A null or empty text has no
    words, null positions, empty labels and score 0. Repeated rows are each scanned; an empty table gives no row.
    """
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    index = Index(templates, word_frequency(docs, vocabulary, text_col), threshold, margin)
    low = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    prefix = F.array(*[F.lit(w) for w in index.prefix_words()])

    none = F.array().cast("array<struct<label:string,share:double>>")
    tokens = F.col("tokens")
    rows = docs.select(F.col(id_col).alias("doc_id"), words(low, NOT_ALNUM).alias("tokens"))
    starts = F.array(*[F.struct(F.lit(label).alias("label"), phrase_starts(tokens, p).alias("at")) for p, label in PHRASES])
    rows = rows.select(
        "doc_id", F.size(tokens).cast("long").alias("n_words"), starts.alias("starts"),
        F.when(F.arrays_overlap(tokens, prefix), let(index.places(tokens), index.matches)).otherwise(none).alias("matches"),
    )
    places = F.flatten(F.col("starts.at"))
    base = F.array_distinct(F.transform(F.filter("starts", lambda s: F.size(s["at"]) > 0), lambda s: s["label"]))
    return rows.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), "matches",
        F.array_join(F.sort_array(F.array_union(base, F.col("matches.label"))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches.share")), F.lit(0.0))).alias("score"),
    )
