"""License scan by diagonal voting, with DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the positions of the same k-grams in
license templates.  Each match votes for a diagonal (position in the text minus position in
the template); votes are summed by diagonal, neighbouring diagonals (inserted or missing
words) are merged into spans unless whole by themselves, and a span is verified by the share of the template's k-grams
that it covers and by its length; of a span that is too long its best diagonal is taken, if it
covers enough.  A base phrase is a template whose every k-gram must vote on
one diagonal, which holds exactly where its words stand consecutively.

Cases: a null text is an empty one, with no words, labels or places and score 0; texts shorter
than a k-gram have no matches; every row is scanned and reported by itself, also rows that share
a doc_id or have none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_COVERAGE = 0.8
MAX_STRETCH = 1.5
DIAGONAL_GAP = 4

BASE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]


def words_column(text: Column) -> Column:
    """Words after lower-casing A-Z only; every character from U+0080 on is part of a word."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def _gram(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def template_positions(spark: SparkSession, base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """One row per k-gram of a template: as many rows as the parameter has words, whatever the corpus."""
    rows = [(t, label, t < len(base), k, len(text.split()) - K + 1, *text.split()[k : k + K]) for t, (label, text) in enumerate([*base, *templates]) for k in range(len(text.split()) - K + 1)]
    table = spark.createDataFrame(rows, "template int, label string, is_base boolean, t_pos int, t_grams int, a string, b string, c string")
    return table.select(_gram([F.col("a"), F.col("b"), F.col("c")]).alias("gram"), "template", "label", "is_base", "t_pos", "t_grams")


def license_spans(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Verified spans: row_id (of the input row, within this table), doc_id, n_words, template, label, is_base, start, end, coverage; one row with a null template for each document without."""
    spark = docs.sparkSession
    # One more element, which always matches, keeps each document and its word count in the same pass.
    keeper = F.xxhash64(F.lit("\x00document"))

    def scanned(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: _gram([F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)]))
        return F.struct(n.cast("long").alias("n_words"), F.concat(F.array(keeper), F.when(n >= K, grams).otherwise(F.array().cast("array<bigint>"))).alias("_g"))

    # Bound to a lambda variable and unnested, the words are split once for a document and not once for each use.
    tokens = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.transform(F.array(words_column(F.col("text"))), scanned)))
    rows = tokens.select("row_id", "doc_id", "n_words", F.posexplode("_g").alias("_p", "gram"))
    keep_row = spark.range(1).select(keeper.alias("gram"), F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_base"), F.lit(0).alias("t_pos"), F.lit(1).alias("t_grams"))
    hits = rows.join(F.broadcast(template_positions(spark, base, templates).unionByName(keep_row)), "gram")
    hits = hits.withColumn("pos", F.col("_p") - 1).withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    by = ["row_id", "doc_id", "n_words", "template", "label", "is_base", "t_grams"]
    diagonals = hits.groupBy(*by, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    # Base phrases and whole templates stay on one diagonal; others merge with the next diagonal if their places also meet.
    alone = F.col("votes") == F.col("t_grams")
    new = F.col("is_base") | alone | F.coalesce(F.lag(alone).over(order) | (F.col("diagonal") - F.lag("diagonal").over(order) > DIAGONAL_GAP) | (F.col("lo") - F.lag("hi").over(order) > DIAGONAL_GAP + K), F.lit(True))
    runs = diagonals.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*by, "_run").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("diagonal"), F.max(F.struct("votes", "lo", "hi")).alias("_best"))
    # A run that is stretched too far is its best diagonal.
    far = F.col("hi") - F.col("lo") + 1 > MAX_STRETCH * F.col("t_grams") + DIAGONAL_GAP
    spans = spans.select(*by, "diagonal", *[F.when(far, F.col(f"_best.{c}")).otherwise(F.col(c)).alias(c) for c in ("votes", "lo", "hi")])
    coverage = F.least(F.col("votes") / F.col("t_grams"), F.lit(1.0))
    whole = F.col("votes") == F.col("t_grams")
    good = spans.filter(F.when(F.col("is_base"), whole).otherwise(coverage >= MIN_COVERAGE))
    start = F.when(F.col("is_base"), F.col("diagonal")).otherwise(F.col("lo"))
    document = F.col("template") < 0
    return good.select("row_id", "doc_id", "n_words", F.when(~document, F.col("template")).alias("template"), "label", "is_base", F.when(~document, start).cast("long").alias("start"), F.when(~document, F.col("hi") + K).cast("long").alias("end"), F.when(~document, coverage).alias("coverage"))


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] = BASE_PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage of a template)."""
    spans = license_spans(docs, base, templates)
    of_base = lambda c: F.when(F.col("is_base"), F.col(c))
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("row_id", "doc_id", "n_words").agg(
        F.count(of_base("start")).alias("n_base"), F.min(of_base("start")).alias("first_word"), F.max(of_base("start")).alias("last_word"),
        join(of_base("label")).alias("base_labels"), join(F.col("label")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    return found.drop("row_id")
