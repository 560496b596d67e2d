"""License scans with a positional index of rare words, in DataFrame functions only.

The index holds, for each word of the licence phrases and templates, where it stands in them. One pass over the texts keeps of
each file where its licence words stand, and writes that; document frequencies are counted over all files. Then, file by file:

* each phrase is looked up by its highest-IDF word, and its other words are compared at their relative places; a phrase counts
  wherever all of them agree;
* the file's highest-IDF licence words (RARE of them) are looked up in the templates' postings. A place in the file and a place in
  a template agree on where the template begins, give or take inserted words (SLACK); a template is a candidate where half of the
  template's places that were looked up agree, and VOTES at least. It counts if its mandatory key phrases stand in the file, too.

score: the part of the document's words that phrases cover, 1 at most. Null and empty texts have no words and no labels; an empty
table gives an empty table. Repeated rows stay; columns beyond doc_id and text are not read. Of words with one IDF the first in
the alphabet comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, lower_ascii, stash

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
MORE = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "the software is provided as is without warranty": "as-is",
}
#: Notices of public licences: label, its mandatory phrases, its words.
TEMPLATES = {
    "mit-notice": (
        ["permission is hereby granted free of charge"],
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    "bsd-notice": (
        ["redistribution and use in source and binary forms"],
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice",
    ),
    "apache-notice": (
        ["licensed under the apache license", "apache license version 2 0"],
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "gpl-notice": (
        ["general public license"],
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "mpl-notice": (["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
}
RARE, VOTES, SLACK = 24, 10, 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD_REGEX), 0)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def licence_words(docs: DataFrame, phrases: dict[str, str], templates: dict) -> DataFrame:
    """doc_id, n_words and spots: (at, w) of all words of phrases and templates, in order."""
    known = sorted({w for p in phrases for w in p.split()} | {w for _, t in templates.values() for w in t.split()})
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda s: s["w"].isin(known))
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), spots.alias("spots"))


def by_rarity(spots: DataFrame) -> list[str]:
    """The licence words that occur, by falling IDF over all documents. One row for each comes back."""
    held = spots.select(F.explode(F.array_distinct(F.transform("spots", lambda s: s["w"]))).alias("w")).groupBy("w").count()
    return [r.w for r in sorted(held.collect(), key=lambda r: (r["count"], r.w))]


def _phrase_places(phrases: dict[str, str], base: dict[str, str], anchor: dict[str, str]) -> Column:
    """(start, size, label, base, phrase) of every phrase, in order. Words of a phrase that stand side by side are side by side in spots, too."""
    numbered = F.transform("spots", lambda s, j: F.struct(s["at"].alias("at"), s["w"].alias("w"), j.alias("j")))
    anchors = F.filter(numbered, lambda s: s["w"].isin(sorted(set(anchor.values()))))

    def at(spot: Column) -> Column:
        tries = []
        for p, label in phrases.items():
            w = p.split()
            first = spot["j"] - w.index(anchor[p])
            start = spot["at"] - w.index(anchor[p])
            agree = (spot["w"] == anchor[p]) & (first >= 0)
            for k, x in enumerate(w):
                own = F.get("spots", first + k)
                agree = agree & F.coalesce((own["w"] == x) & (own["at"] == start + k), F.lit(False))
            tries.append(F.when(agree, F.struct(start.cast("long").alias("start"), F.lit(len(w)).alias("size"), F.lit(label).alias("label"), F.lit(p in base).alias("base"), F.lit(p).alias("phrase"))))
        return F.array_compact(F.array(*tries))

    return F.array_sort(F.flatten(F.transform(anchors, at)))


def _longest_run(values: Column) -> Column:
    """How often the most frequent of some numbers occurs."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda a: a["best"])


def _votes(postings: Column, own: list[str], size: int, shift: int) -> Column:
    """How many of a template's places agree best with the file on where the template begins, within SLACK words."""

    def begins(s: Column) -> Column:
        return F.transform(F.element_at(postings, s["w"]), lambda p: F.floor((s["at"] - p + size + shift) / SLACK) * 4096 + p)

    hits = F.filter("spots", lambda s: s["w"].isin(own) & F.array_contains("rare", s["w"]))
    return _longest_run(F.transform(F.array_distinct(F.flatten(F.transform(hits, begins))), lambda x: F.floor(x / 4096)))


def _template_label(label: str, mandatory: list[str], text: str) -> Column:
    """The label if the template stands in the file, else null. rare: the file's highest-IDF licence words."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(text.split()):
        at.setdefault(w, []).append(i)
    postings, own, size = F.create_map(*[x for w, places in at.items() for x in (F.lit(w), F.array(*map(F.lit, places)))]), sorted(at), len(text.split())
    looked_up = F.aggregate(F.filter("rare", lambda w: w.isin(own)), F.lit(0), lambda a, w: a + F.size(F.element_at(postings, w)))
    best = F.greatest(_votes(postings, own, size, 0), _votes(postings, own, size, SLACK // 2))
    phrases = F.transform("places", lambda x: x["phrase"])
    there = F.size(F.array_intersect(phrases, _strings(mandatory))) == len(mandatory)
    # the phrases first: most files have none
    return F.when(there, F.when((best >= VOTES) & (2 * best >= looked_up), F.lit(label)))


def scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = MORE, templates: dict = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places: (start, size, label, base, phrase) of every phrase in words from 0, in order, and templates: labels of those that stand in the file."""
    phrases = {**more, **base}
    spots = stash(licence_words(docs, phrases, templates), "licence")
    rarity = by_rarity(spots)
    rank = {w: k for k, w in enumerate(rarity)}
    anchor = {p: min(p.split(), key=lambda w: (rank.get(w, -1), w)) for p in phrases}
    order = _strings(rarity)
    distinct = F.array_distinct(F.transform("spots", lambda s: s["w"]))
    rare = F.transform(F.slice(F.array_sort(F.transform(distinct, lambda w: F.struct(F.array_position(order, w).alias("k"), w.alias("w")))), 1, RARE), lambda x: x["w"])
    placed = spots.select("doc_id", "n_words", "spots", _phrase_places(phrases, base, anchor).alias("places"))
    some = F.when(F.size("places") > 0, rare).otherwise(F.array().cast("array<string>"))
    return placed.withColumn("rare", some).select("doc_id", "n_words", "places", F.array_compact(F.array(*[_template_label(k, *t) for k, t in templates.items()]).cast("array<string>")).alias("templates"))


def report(found: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    covered = F.aggregate("places", F.lit(0), lambda a, p: a + p["size"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.transform("places", lambda p: p["label"]), F.col("templates"))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.least(F.lit(1.0), covered / F.col("n_words"))).otherwise(0.0).alias("score"),
    )
