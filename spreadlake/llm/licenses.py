"""License scans by diagonal voting.

All rolling word k-grams of every text are joined by hash to the positions of
the templates' k-grams, whose table is fixed and small.  A hit votes for its
diagonal, the document position less the template position; votes are summed by
diagonal before the shuffle.  Diagonals that lie next to each other (a word was
put in or left out) are merged, and a merged span counts if it covers enough of
the template's words.  Only DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals at most this far apart, and this share of a template's words, make a verified span.
SLACK, COVERED = 3, 0.7
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The phrases of the base rule and their labels.
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
# Notices as their licences word them, in lower case without marks.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quick way to the same result."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK, -1), lambda w: w != "")


def template_grams(like: DataFrame) -> DataFrame:
    """One row per k-gram of each template: its hash, words, template, position and the template's number of words."""
    rows = like.sparkSession.createDataFrame([(i, label, text.split()) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, said array<string>")
    return rows.select(
        "template", "label", F.size("said").alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("said") - (K - 1)), lambda i: F.slice("said", i, K))).alias("tpos", "gram")
    ).withColumn("hash", F.xxhash64("gram"))


def spans(docs: DataFrame, key: list[str], said: str) -> DataFrame:
    """Verified spans: the key columns, label, first and last word, share covered.

    ``said`` names the array of words.  A gram counts where its words, not only
    its hash, equal the template's.
    """
    # only a gram's own words go with it: the whole array beside each would be a text's length squared
    grams = F.transform(F.sequence(F.lit(1), F.size(said) - (K - 1)), lambda i: F.slice(said, i, K))
    rolled = docs.filter(F.size(said) >= K).select(*key, F.posexplode(grams).alias("dpos", "words")).withColumn("hash", F.xxhash64("words"))
    hits = rolled.join(F.broadcast(template_grams(docs)), "hash").filter(F.col("words") == F.col("gram"))
    voted = (
        hits.groupBy(*key, "template", "label", "size", (F.col("dpos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("at"), F.min("dpos").alias("first"), F.max("dpos").alias("last"))
    )
    line = Window.partitionBy(*key, "template").orderBy("diagonal", "first")
    gap = F.col("diagonal") - F.lag("diagonal").over(line)
    merged = (
        voted.withColumn("opens", F.when(gap <= SLACK, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(line))
        .groupBy(*key, "template", "label", "size", "run")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.min("first").alias("first"), (F.max("last") + (K - 1)).alias("last"))
    )
    reach = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(K)), F.lit(K)))
    covered = F.aggregate(reach, F.lit(0), lambda a, x: a + x) / F.col("size")
    return merged.select(*key, "label", "first", "last", covered.alias("covered")).filter(F.col("covered") >= COVERED)


def phrase_places(said: str) -> Column:
    """(label, first word) of every place where a base phrase stands, by place."""

    def places(label: str, phrase: tuple[str, ...]) -> Column:
        first = F.filter(F.transform(said, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
        whole = F.filter(first, lambda i: F.slice(said, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
        return F.transform(whole, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.array_sort(F.concat(*[places(label, phrase) for label, phrase in PHRASES.items()]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, counts and labels, and the verified spans.

    A null text has no words.  Rows are told apart by id and text: repeated rows
    get the same result each, and rows that share an id (or have none) but not a
    text get their own.  ``score`` is 1 where a base phrase stands and else the
    best span's share of its template (0 without one).
    """
    taken = docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    said = taken.select("key", F.xxhash64("text").alias("print"), words(F.col("text")).alias("said"), F.lower("text").contains("license").alias("likely"))
    # a text without the word has no phrase; the phrases' letters have no other upper case in Unicode
    base = said.select("key", "print", F.size("said").cast("long").alias("n_words"), F.when(F.col("likely"), phrase_places("said")).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("places"))
    found = spans(said.select("key", "print", "said"), ["key", "print"], "said")
    per_doc = found.groupBy("key", "print").agg(F.collect_set("label").alias("extra"), F.max("covered").alias("best"), F.sort_array(F.collect_set(F.struct("first", "last", "label", "covered"))).alias("spans"))
    joined = base.alias("b").join(per_doc.alias("m"), F.expr("b.key <=> m.key AND b.print = m.print"), "left")
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    join_sorted = lambda a: F.array_join(F.array_sort(a), ",")
    places = F.col("places")
    return joined.select(
        F.col("b.key").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get(places, F.lit(0))["at"].cast("long").alias("first_word"),
        F.get(places, F.size("places") - 1)["at"].cast("long").alias("last_word"),
        join_sorted(labels).alias("base_labels"),
        join_sorted(F.array_union(labels, F.coalesce("extra", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "spans",
    )
