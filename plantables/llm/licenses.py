"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of a text, and every rolling run of four, is joined by
hash to the places where license texts have it. A hit votes for a diagonal:
its place in the document less its place in the template. Diagonals that lie
near each other are merged into one span, as a word left out or put in shifts
the rest, and a span is verified by the part of the template that it covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that must stand word by word, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Passages of public licenses, found when enough of them stands there, with their labels.
PASSAGES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-released": "released under the mit license",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-licensed": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-licensed": "this work is licensed under the gnu general public license version 3",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
}
#: Words of a run by which passages are found; and the part of a passage that must be covered.
RUN, COVERED = 4, 0.6
#: Diagonals up to so far apart are one span, if the next starts within so many words of what the span reached.
NEAR, GAP = 3, 12
#: Separators: ASCII but for digits and lower-case letters (texts are lowered first).
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_SEPARATOR_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isdigit() and not chr(c).islower())


def words_of(text: Column) -> Column:
    """The words of a text, lowered; none of null."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SEPARATOR_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def _run(words: Column, at: Column, n: int) -> list[Column]:
    return [F.get(words, at + i) for i in range(n)]


def templates(spark, texts: list[tuple[str, str]], kind: int, n: int) -> DataFrame:
    """Each run of n words of some (text, label) -> (hash, hits of (kind, template, its runs, place, the words))."""
    rows = []
    for name, (text, label) in enumerate(texts):
        words = text.split()
        runs = len(words) - n + 1
        rows += [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("template"), F.lit(label).alias("label"), F.lit(runs).alias("runs"), F.lit(i).alias("place"), F.array(*map(F.lit, words[i : i + n])).alias("words")) for i in range(runs)]
    each = spark.range(1).select(F.explode(F.array(*rows)).alias("hit"))
    return each.groupBy(F.xxhash64(*_run(F.col("hit.words"), F.lit(0), n)).alias("hash")).agg(F.collect_list("hit").alias("hits"))


def scan(docs: DataFrame, base: dict[str, str] | None = None, passages: dict[str, str] | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: all places where a base phrase stands word by word; first_word and
    last_word: the smallest and largest of their starts, else null. spans:
    (label, start, end, score) of verified passages, the best part covered as
    score. score: 1 with a base phrase, else the best span's, else 0. Null and
    wordless texts have no words. Rows that repeat an id and text have each
    the same result. An empty table gives none. Other columns aren't read.
    The templates are broadcast: a few hundred rows set by these parameters.
    """
    spark = docs.sparkSession
    base = BASE if base is None else base
    passages = PASSAGES if passages is None else passages
    pairs = templates(spark, list(base.items()), 0, 2).withColumnsRenamed({"hash": "hash2", "hits": "hits2"})
    runs = templates(spark, [(t, k) for k, t in passages.items()], 1, RUN).withColumnsRenamed({"hash": "hash4", "hits": "hits4"})

    text = F.col("text").cast("string")
    each = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("which"), words_of(text).alias("w"))
    # The place after the last word stands for the document itself. Only the words of a run go on from here, not the
    # document's array; and no higher-order function, so that all words pass within one generated stage.
    at = each.select("doc_id", "which", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    run = _run(F.col("w"), F.col("at"), RUN)
    hashed = at.select("doc_id", "which", "n_words", "at", F.xxhash64(*run[:2]).alias("hash2"), F.xxhash64(*run).alias("hash4"), *(x.alias(f"w{i}") for i, x in enumerate(run)))
    met = hashed.join(F.broadcast(pairs), "hash2", "left").join(F.broadcast(runs), "hash4", "left")
    own = F.col("at") == F.col("n_words")
    met = met.filter(F.col("hits2").isNotNull() | F.col("hits4").isNotNull() | own)
    none = F.expr("array()").cast("array<struct<kind: int, template: int, label: string, runs: int, place: int, words: array<string>>>")
    vote = met.select("doc_id", "which", "n_words", "at", own.alias("own"), *(f"w{i}" for i in range(RUN)), F.explode_outer(F.concat(F.coalesce("hits2", none), F.coalesce("hits4", none))).alias("h"))
    same = reduce(lambda done, i: done & (F.get("h.words", F.lit(i)).isNull() | (F.get("h.words", F.lit(i)) == F.col(f"w{i}"))), range(RUN), F.col("h").isNotNull())
    vote = vote.filter(F.col("own") | F.coalesce(same, F.lit(False)))
    diagonals = vote.groupBy("doc_id", "which", F.col("h.kind").alias("kind"), F.col("h.template").alias("template"), (F.col("at") - F.col("h.place")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"),
        F.max("h.label").alias("label"),
        F.max("h.runs").alias("runs"),
        F.collect_set("h.place").alias("places"),
        F.min("at").alias("start"),
        F.max("at").alias("end"),
        F.count_if("own").alias("rows"),
    )
    # neighbouring diagonals of a passage become one span
    order = Window.partitionBy("doc_id", "which", "kind", "template").orderBy("start", "diagonal")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("kind") == 0) | F.coalesce((F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > NEAR) | (F.col("start") - reach > GAP), F.lit(True))
    spans = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(order))
    merged = spans.groupBy("doc_id", "which", "kind", "template", "span").agg(
        F.max("n_words").alias("n_words"),
        F.max("label").alias("label"),
        F.max("runs").alias("runs"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("rows").alias("rows"),
    )
    part = F.col("covered") / F.col("runs")
    exact = (F.col("kind") == 0) & (F.col("covered") == F.col("runs"))
    found = (F.col("kind") == 1) & (part >= COVERED)

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")

    by_doc = merged.groupBy("doc_id", "which").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(exact | found).alias("labels"),
        F.coalesce(F.max(F.when(exact, F.lit(1.0)).when(found, part)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct("label", F.col("start").cast("long").alias("start"), (F.col("end") + RUN).cast("long").alias("end"), part.alias("score"))))).alias("spans"),
        F.sum("rows").cast("int").alias("rows"),
    )
    return by_doc.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows", "which")
