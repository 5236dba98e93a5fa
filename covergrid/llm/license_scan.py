"""License scans by diagonal voting.

All rolling word 3-gram hashes of every text join the hashes of the templates' positions (the
templates are constants of this module, so their table has a proven bound and is broadcast). A match
at word p of the text and t of a template votes for diagonal p - t; each match compares the words
themselves, not just their hash. Votes are aggregated by (text, template, diagonal).

Verification takes a text's diagonals of one template in order; neighbours at most DRIFT apart, and
SPREAD in all, are merged so that small insertions and omissions don't break a notice. The matches of
such a cluster are aligned in order: the longest chain of matches whose places grow both in the text
and in the template. The chain must cover the share COVERED of the template's words, and every
*key* of the template, a run of words that tells the licence from its relatives ("version 3",
"attribution noncommercial 4"), must be matched word after word. Of verified spans that overlap in
the text only the label of the best remains (most words covered, then the largest share).

Base templates (phrases) are never merged and must be covered whole on one diagonal: such a diagonal
is a place where the phrase's words stand consecutively, and the diagonal is its first word.

Defined results: null and empty texts have no words, no places, empty labels and score 0; score is
the largest share covered by any verified span; rows that repeat a doc_id are told apart by their
text, rows that repeat both share a result; of spans that tie in all, the label that sorts first wins;
texts are scanned whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covergrid.llm.util import alnum_words

GRAM = 3
#: Neighbouring diagonals of one notice lie at most DRIFT apart, all of them within SPREAD.
DRIFT, SPREAD = 3, 8
#: Share of a template's words that a span must cover.
COVERED = 0.8

# The contract's phrases and the labels that they stand for.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Sentences by which well-known licences are granted. What stands in brackets is a key.
NOTICES = {
    "agpl-3": [
        "under the terms of the [GNU Affero General Public License] as published by the Free Software Foundation, either [version 3 of the License]",
        "licensed under the [GNU Affero General Public License, version 3]",
    ],
    "apache-2": [
        "Licensed under the [Apache License, Version 2.0]",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www [apache org licenses LICENSE-2.0]",
    ],
    "bsd": [
        "[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by": ["This work is licensed under a Creative Commons [Attribution 4.0] International License", "Licensed under [CC BY 4.0]"],
    "cc-by-nc": ["This work is licensed under a Creative Commons [Attribution-NonCommercial 4.0] International License", "Licensed under [CC BY-NC 4.0]"],
    "cc-by-nc-nd": ["This work is licensed under a Creative Commons [Attribution-NonCommercial-NoDerivatives 4.0] International License", "Licensed under [CC BY-NC-ND 4.0]"],
    "cc-by-nc-sa": ["This work is licensed under a Creative Commons [Attribution-NonCommercial-ShareAlike 4.0] International License", "Licensed under [CC BY-NC-SA 4.0]"],
    "cc-by-nd": ["This work is licensed under a Creative Commons [Attribution-NoDerivatives 4.0] International License", "Licensed under [CC BY-ND 4.0]"],
    "cc-by-sa": ["This work is licensed under a Creative Commons [Attribution-ShareAlike 4.0] International License", "Licensed under [CC BY-SA 4.0]"],
    "cc0": ["To the extent possible under law, the person who associated CC0 with this work has [waived all copyright and related or neighboring rights] to this work"],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the [Eclipse Public License 2.0]"],
    "gpl-2": [
        "This work is licensed under the [GNU General Public License, version 2]",
        "under the terms of the [GNU General Public License as published] by the Free Software Foundation, either [version 2 of the License]",
    ],
    "gpl-3": [
        "This work is licensed under the [GNU General Public License, version 3]",
        "under the terms of the [GNU General Public License as published] by the Free Software Foundation, either [version 3 of the License]",
    ],
    "isc": ["[Permission to use, copy, modify, and or distribute this software] for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation",
        "This work is licensed under the [GNU Lesser General Public License]",
    ],
    "mit": [
        "Released under the [MIT License]",
        "[Permission is hereby granted], free of charge, to any person [obtaining a copy of this software] and associated documentation files",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the [Mozilla Public License, v. 2.0]"],
    "unlicense": ["This is [free and unencumbered software released into the public domain]"],
}


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


@cache
def templates() -> list[tuple[int, str, bool, list[str], list[tuple[int, int]]]]:
    """(number, label, base, words, keys as word ranges). A key takes in neighbours until it is GRAM words."""
    out = [(i, label, True, phrase.split(), []) for i, (phrase, label) in enumerate(BASE.items())]
    for label, notices in NOTICES.items():
        for notice in notices:
            words, keys = [], []
            for i, part in enumerate(re.split(r"[\[\]]", notice)):
                more = _words(part)
                if i % 2:
                    keys.append((len(words), len(words) + len(more)))
                words += more
            keys = [(max(0, b - max(GRAM, b - a)), b) for a, b in keys]
            out.append((len(out), label, False, words, keys))
    return out


def _template_grams(spark: SparkSession) -> DataFrame:
    rows = [{"template": i, "t": t, "gram": w[t : t + GRAM]} for i, _, _, w, _ in templates() for t in range(len(w) - GRAM + 1)]
    made = spark.createDataFrame(pa.Table.from_pylist(rows))  # from Arrow: no Python on the executors
    return made.withColumn("hash", F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(GRAM))))


def chain(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (t, p) that grows in both; of equally long ones that which ends earliest in the text."""
    matches = sorted(matches, key=lambda m: (m[0], -m[1]))
    tails, at, before = [], [], [-1] * len(matches)
    for i, (_, p) in enumerate(matches):
        k = bisect_left(tails, p)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [p]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(matches[i])
        i = before[i]
    return out[::-1]


def verified(template: int, matches: list[tuple[int, int]]) -> tuple[int, int, int, float] | None:
    """(first word, last word + 1, words covered, share) of a cluster's matches (t, p), if they make a notice."""
    _, _, _, words, keys = templates()[template]
    kept = chain(matches)
    places = dict(kept)
    covered = len({t + i for t, _ in kept for i in range(GRAM)})
    if covered < COVERED * len(words):
        return None
    for a, b in keys:
        if a not in places or any(places.get(t) != places[a] + t - a for t in range(a, b - GRAM + 1)):
            return None
    return kept[0][1], kept[-1][1] + GRAM, covered, covered / len(words)


def clusters(diagonals: list[tuple[int, list[int]]]) -> Iterator[list[tuple[int, int]]]:
    """Matches (t, p) of neighbouring diagonals (diagonal, its ts), merged."""
    held, first, last = [], 0, 0
    for diagonal, ts in sorted(diagonals):
        if held and (diagonal - last > DRIFT or diagonal - first > SPREAD):
            yield held
            held = []
        if not held:
            first = diagonal
        held += [(t, t + diagonal) for t in ts]
        last = diagonal
    if held:
        yield held


def notices(found: list[tuple[int, int, list[int]]]) -> list[tuple[str, bool, int, float]]:
    """(label, base, first word, share) of a text's spans, given all its (template, diagonal, ts)."""
    by_template: dict[int, list[tuple[int, list[int]]]] = {}
    for template, diagonal, ts in found:
        by_template.setdefault(template, []).append((diagonal, ts))
    out, spans = [], []
    for template, diagonals in by_template.items():
        _, label, base, words, _ = templates()[template]
        if base:
            out += [(label, True, d, 1.0) for d, ts in diagonals if len(set(ts)) == len(words) - GRAM + 1]
        else:
            spans += [(-v[2], -v[3], label, *v[:2]) for m in clusters(diagonals) if (v := verified(template, m))]
    taken: list[tuple[int, int]] = []  # disjoint or of one label, by their start
    labels: dict[tuple[int, int], str] = {}
    for covered, share, label, a, z in sorted(spans):
        i = bisect_left(taken, (a, a))
        meets = [s for s in taken[max(0, i - 1) : i] if s[1] > a]
        while i < len(taken) and taken[i][0] < z:
            meets.append(taken[i])
            i += 1
        if all(labels[s] == label for s in meets):
            out.append((label, False, a, -share))
            if not meets:
                taken.insert(bisect_left(taken, (a, z)), (a, z))
                labels[a, z] = label
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, rows = [], []
        for i, found in enumerate(b.column(2).to_pylist()):
            for row in notices([(x["template"], x["diagonal"], x["ts"]) for x in found]):
                at.append(i)
                rows.append(row)
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.float64()))]
        keep = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), *cols], ["doc_id", "rk", "label", "base", "start", "share"])


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, rk (a hash of the text), label, base, start (first word), share."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("rk"), alnum_words(F.col("text")).alias("words"))
    # The outer form, as for the inner one Spark would split each text twice: once to see whether it has words.
    at = keyed.select("doc_id", "rk", "words", F.posexplode_outer("words").alias("p", "word")).filter("word is not null")
    following = [F.get("words", F.col("p") + i) for i in range(1, GRAM)]
    grams = at.select("doc_id", "rk", "p", F.array("word", *following).alias("here"), F.xxhash64("word", *following).alias("hash"))
    votes = grams.join(F.broadcast(_template_grams(docs.sparkSession)), "hash").filter(F.col("here") == F.col("gram"))
    # Of texts with equal rows each place is found again: sets make that harmless.
    diagonals = votes.groupBy("doc_id", "rk", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    # A text's diagonals: no more than its words.
    texts = diagonals.groupBy("doc_id", "rk").agg(F.collect_list(F.struct(F.col("template").cast("long").alias("template"), F.col("diagonal").cast("long").alias("diagonal"), "ts")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_spans, f"doc_id {kind}, rk long, label string, base boolean, start long, share double")


def report(docs: DataFrame) -> DataFrame:
    """A row for every document."""
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    based = F.when(F.col("base"), F.col("start"))
    found = (
        spans(docs).groupBy(F.col("doc_id").alias("found_id"), F.col("rk").alias("found_rk"))
        .agg(
            F.count(based).alias("n_base"), F.min(based).alias("first_word"), F.max(based).alias("last_word"),
            labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("share").alias("score"),
        )
    )
    every = docs.select("doc_id", F.xxhash64("text").alias("rk"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("rk") == F.col("found_rk")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
