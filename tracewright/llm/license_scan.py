"""Licence phrases and texts found by votes of word k-grams on offset diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, rows_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose consecutive words give a base label.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Opening or notice sentences of public licences, and the label that a near match of one gives.
TEXTS = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

PHRASE_GRAM, TEXT_GRAM = 2, 3


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased; null text is empty."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def grams() -> Column:
    """At each position of the column `words` the next TEXT_GRAM words, fewer at the end; behind the last an empty gram."""
    return F.concat(F.transform("words", lambda _, i: F.slice("words", i + 1, TEXT_GRAM)), F.array(F.array().cast("array<string>")))


def gram_hash(gram: str) -> Column:
    """Of the first PHRASE_GRAM words: the join key of both kinds of template, whose whole grams are compared after it."""
    return F.xxhash64(*[F.get(F.col(gram), F.lit(i)) for i in range(PHRASE_GRAM)])


def templates(spark: SparkSession, phrases: list[tuple[str, str]], texts: list[tuple[str, str]]) -> DataFrame:
    """Positions of all template grams; its size is fixed by the arguments."""
    rows = [(i, label, kind, k, len(words.split()), words) for i, (label, words, kind, k) in enumerate([(*p, "phrase", PHRASE_GRAM) for p in phrases] + [(*t, "text", TEXT_GRAM) for t in texts])]
    table = rows_of(spark, rows, "template int, label string, kind string, gram int, length int, text string").withColumn("words", words_of(F.col("text")))
    found = table.select("template", "label", "kind", "gram", (F.col("length") - (F.col("gram") - 1)).alias("t_grams"), F.posexplode(grams()).alias("t_pos", "t_gram"))
    found = found.withColumn("t_gram", F.slice("t_gram", 1, F.col("gram"))).where(F.size("t_gram") == F.col("gram"))
    # a document's empty gram meets template -1: it carries the word count and keeps documents without a match
    none = rows_of(spark, [(-1, "", "count", 0, 1, 0)], "template int, label string, kind string, gram int, t_grams int, t_pos int").withColumn("t_gram", F.array().cast("array<string>"))
    return found.unionByName(none).withColumn("t_hash", gram_hash("t_gram"))


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str]] = TEXTS, min_cover: float = 0.6, max_shift: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): one row per row of `docs`.

    `spans` is an array of (label, kind, first, last, cover), ordered: for a phrase
    each place where its words stand in a row; for a text each place where at least
    `min_cover` of its grams stand on diagonals that lie at most `max_shift` words
    apart in turn, so words may be added or missing. first and last are word
    positions from 0, cover the share of the template's grams that were found.

    The grams at all positions of all documents join the template positions by hash,
    and the words themselves are compared at once. Only matches are shuffled.

    Null or empty text has 0 words and no spans. Repeated rows are scanned one by
    one, also those with the same or a null doc_id.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text)).alias("words"))
    votes = base.select("doc_id", "row", F.posexplode(grams()).alias("pos", "words"))
    known = F.broadcast(templates(docs.sparkSession, phrases, texts))
    hits = votes.join(known, gram_hash("words") == F.col("t_hash")).where(F.slice("words", 1, F.col("gram")) == F.col("t_gram"))
    hits = hits.where((F.col("gram") > 0) | (F.size("words") == 0))

    diagonals = hits.select("doc_id", "row", "template", "label", "kind", "t_grams", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"), F.col("gram").alias("size"))
    diagonals = diagonals.groupBy("row", "doc_id", "template", "label", "kind", "t_grams", "diagonal").agg(F.collect_set("t_pos").alias("t_set"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("size") - 1).alias("last"))
    # one shuffle by row serves the windows and both later groupings
    turn = Window.partitionBy("row").orderBy("template", "diagonal")
    near = (F.col("kind") == "text") & (F.lag("template").over(turn) == F.col("template")) & (F.col("diagonal") - F.lag("diagonal").over(turn) <= max_shift)
    merged = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "doc_id", "cluster", "template", "label", "kind", "t_grams").agg(F.array_distinct(F.flatten(F.collect_list("t_set"))).alias("t_all"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.withColumn("cover", F.size("t_all") / F.col("t_grams"))
    keep = ((F.col("kind") == "phrase") & (F.col("cover") == 1.0)) | ((F.col("kind") == "text") & (F.col("cover") >= min_cover))
    span = F.when(keep, F.struct("label", "kind", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "cover"))
    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("kind") == "count", F.col("first"))).cast("long").alias("n_words"), F.sort_array(F.collect_list(span)).alias("spans")
    ).drop("row")
