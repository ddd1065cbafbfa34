"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined with the positions that templates have them at. A match votes for its
diagonal, the place in the text less the place in the template. Votes are summed by diagonal, neighbouring diagonals (a
word more or less) are merged. Each merged span is then aligned with its template word by word: enough of the template's
words must stand there in order, among them those that tell it from similar ones, and none of a similar one's. Where
spans of several templates overlap, the best one stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import prepared, stored

GRAM = 3
# Diagonals at most this far apart belong to one span.
NEIGHBOUR = 3
# Share of a notice's k-grams that must be confirmed, and then of its words.
COVERED = 0.6

# Phrases that count wherever their words stand consecutively.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Opening words of public license notices, found also with small changes.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
                 "License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
# Words that must be in a notice's span, and words that make it another license.
DEMANDED = {"lgpl": {"lesser"}, "cc-by-nc": {"noncommercial"}, "cc-by-sa": {"sharealike"}}
OTHERS = {
    "gpl": {"lesser", "library", "affero"}, "lgpl": {"affero"},
    "cc-by": {"noncommercial", "sharealike", "noderivatives", "noderivs"},
    "cc-by-sa": {"noncommercial", "noderivatives", "noderivs"},
}
# The same words written as two.
SPLIT = {("non", "commercial"), ("share", "alike"), ("no", "derivatives"), ("no", "derivs")}
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of ASCII letters and digits and all non-ASCII characters, with A-Z lower-cased; none for a null text."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), SEPARATOR), "")


def grams_of(words: Column) -> Column:
    """Hash of every window of ``GRAM`` words, by position."""
    last = F.size(words) - GRAM
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


@lru_cache(maxsize=1 << 12)
def aligned(template: int, window: tuple[str, ...]) -> tuple[int, int, int] | None:
    """(first word, word after the last, words in common) of the best alignment of a notice with a window of a text, or
    None where too few words agree, one that it demands is missing or one of another license is between.

    The alignment keeps the order of both, and of those with most words the shortest is taken.
    """
    label, notice = (PHRASES + NOTICES)[template]
    own, text, at = plain_words(notice), [], []
    i = 0
    while i < len(window):
        pair = window[i:i + 2] in SPLIT
        text.append("".join(window[i:i + 2]) if pair else window[i])
        at.append(i)
        i += 1 + pair
    at.append(len(window))
    # best[j]: (words in common, first word) of the notice's first j words with the text so far
    best = [(0, 0)] * (len(own) + 1)
    most = (0, 0, 0)
    for i, word in enumerate(text):
        new = [(0, 0)]
        for j, other in enumerate(own):
            value = max(best[j + 1], new[j])
            if word == other:
                count, first = best[j]
                value = max(value, (count + 1, first if count else i))
            new.append(value)
        best = new
        count, first = best[-1]
        if count and (count, first - i) > (most[0], most[1] - most[2]):
            most = (count, first, i)
    count, first, last = most
    if count < COVERED * len(own):
        return None
    inside = set(text[first:last + 1])
    if not DEMANDED.get(label, set()) <= inside or OTHERS.get(label, set()) & inside:
        return None
    return at[first], at[last + 1], count


def best_spans(spans: list[dict]) -> list[tuple[int, int, float]]:
    """(template, first word, share of its words) of a text's merged spans that stand when they are aligned.

    Of overlapping ones of different templates that with the larger share stays, then the longer, then the first template.
    """
    found = []
    for span in spans:
        words = {}
        for piece in span["pieces"]:
            words.update(enumerate(piece["words"], piece["first"]))
        first = min(words)
        place = aligned(span["template"], tuple(words[i] for i in range(first, max(words) + 1)))
        if place:
            size = len(plain_words((PHRASES + NOTICES)[span["template"]][1]))
            found.append((-place[2] / size, -place[2], span["template"], first + place[0], first + place[1]))
    kept, starts = [], {}
    for share, _, template, start, end in sorted(found):
        if all(other == template for p in range(start, end) for other in starts.get(p, ())):
            kept.append((template, start, -share))
            for p in range(start, end):
                starts.setdefault(p, set()).add(template)
    return kept


def verified(runs: DataFrame) -> DataFrame:
    """(k, text_hash, template, start, coverage) of the merged spans of each text that its words confirm."""
    fields = [runs.schema["k"], runs.schema["text_hash"], T.StructField("template", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("coverage", T.DoubleType())]
    gathered = runs.groupBy("k", "text_hash").agg(F.collect_list(F.struct("template", "pieces")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *span) for i, spans in enumerate(batch.column("spans").to_pylist()) for span in best_spans(spans)]
            at, template, start, share = zip(*rows, strict=True) if rows else ((), (), (), ())
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(taken), batch.column("text_hash").take(taken), pa.array(template, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(share, pa.float64())], names=[f.name for f in fields])

    return prepared(gathered).mapInArrow(run, T.StructType(fields))


def templates(spark: SparkSession) -> DataFrame:
    """One row for each k-gram position of each template; as many rows as the fixed texts above have words."""
    rows = []
    for number, (label, text) in enumerate(PHRASES + NOTICES):
        words = plain_words(text)
        grams = len(words) - GRAM + 1
        rows += [(number, label, number < len(PHRASES), grams, i, words[i:i + GRAM]) for i in range(grams)]
    kind = "template int, label string, exact boolean, n_grams int, template_at int, gram array<string>"
    table = spark.createDataFrame(rows, kind)
    return table.withColumn("gram_hash", F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(GRAM)]))


def license_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, template, label, exact, start, coverage): each confirmed span of each distinct (key, text).

    ``start`` is the phrase's first word, or the first word of a notice that agrees.
    """
    words = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("words"))
    grams = words.select("k", "text_hash", "words", F.posexplode(grams_of(F.col("words"))).alias("at", "gram_hash"))
    found = grams.join(F.broadcast(templates(df.sparkSession)), "gram_hash")
    confirmed = found.filter(F.slice("words", F.col("at") + 1, GRAM) == F.col("gram"))
    same = ["k", "text_hash", "template", "label", "exact", "n_grams"]
    diagonal = F.col("at") - F.col("template_at")
    first = F.greatest(diagonal, F.lit(0))
    # The words that the template would cover on this diagonal; of a phrase none are needed.
    around = F.when(~F.col("exact"), F.slice("words", first + 1, diagonal + F.col("n_grams") + GRAM - 1 - first))
    votes = stored(confirmed.groupBy(*same, diagonal.alias("diagonal")).agg(
        F.collect_set("template_at").alias("places"), F.first(around).alias("words")), "license-votes")
    phrases = votes.filter("exact AND size(places) = n_grams").select(
        "k", "text_hash", "template", "label", "exact", F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("coverage"))
    along = Window.partitionBy("k", "text_hash", "template").orderBy("diagonal")
    breaks = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR, F.lit(True)).cast("int")
    runs = votes.filter("NOT exact").withColumn("new", breaks).withColumn("run", F.sum("new").over(along))
    merged = (
        runs.groupBy("k", "text_hash", "template", "n_grams", "run")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
             F.collect_list(F.struct(F.greatest("diagonal", F.lit(0)).alias("first"), "words")).alias("pieces"))
        .filter(F.size("places") >= COVERED * F.col("n_grams"))
    )
    labels = F.array(*[F.lit(label) for label, _ in PHRASES + NOTICES])
    notices = verified(merged).select(
        "k", "text_hash", "template", F.get(labels, F.col("template")).alias("label"), F.lit(False).alias("exact"), "start", "coverage")
    return phrases.unionByName(notices).withColumnRenamed("k", key).select(
        key, "text_hash", "template", "label", "exact", "start", "coverage")


RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df`` and, for each row's whole text, its license phrases and notices.

    A null or empty text has no words and no labels. Repeated rows get the same result, and a null key is a key like any
    other. Columns of ``df`` with a result's name are replaced; an empty table stays empty. K-grams that no template has
    go no further than the broadcast join, so only votes are shuffled. The base columns count exact phrases; ``labels``
    adds those of notices, and ``score`` is the largest confirmed share of a template's words.
    """
    spans = license_spans(df, key, text)
    base = F.col("exact")
    found = spans.groupBy(F.col(key).alias("__k"), F.col("text_hash").alias("__h")).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    docs = df.select(*[c for c in df.columns if c not in RESULTS], F.xxhash64(text).alias("__hash"),
                     F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    joined = docs.join(found, docs[key].eqNullSafe(found["__k"]) & (docs["__hash"] == found["__h"]), "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return joined.select(
        *[c for c in df.columns if c not in RESULTS], "n_words",
        *[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in RESULTS[1:]])
