"""Operator 2: license scan by diagonal voting, with DataFrame functions only.

The hashes of all rolling word pairs of a text are joined to the places where
the pairs stand in templates. Matches on one diagonal (place in the text less
place in the template) vote together; neighbouring diagonals, apart by a word
or two put in or left out, are merged; a span is confirmed when enough of its
template has voted on it and it is not much longer than the template. A phrase
stands where all its pairs vote on one diagonal.

The templates are a fixed list, so their side of the join is always small. A
text's pairs leave the join only where they match, besides one marker row that
carries the text's own counts; what is shuffled is in proportion to documents
and matches, and every group is one template's matches in one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import lower_ascii, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count wherever their words stand together.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of widely used licenses, with the label of each.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)


def template_pairs(spark) -> DataFrame:
    """Each rolling word pair of the phrases (ids from 0) and templates (ids from 1000): tid, label, size, at, hash."""
    listed = [(i, label, words) for i, (words, label) in enumerate(PHRASES.items())]
    listed += [(1000 + i, label, words) for i, (label, words) in enumerate(TEMPLATES)]
    rows = [(tid, label, len(w) - 1, at, w[at], w[at + 1]) for tid, label, words in listed for w in [words.split()] for at in range(len(w) - 1)]
    pairs = spark.createDataFrame(rows, "tid int, label string, size int, at int, a string, b string")
    return pairs.select("tid", "label", "size", "at", F.xxhash64("a", "b").alias("hash"))


def scan(docs: DataFrame, coverage: float = 0.8, stretch: float = 1.5, gap: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` adds those of templates of whose pairs a share of ``coverage``
    stands in a span of at most ``stretch`` times the template's words.
    ``score`` is the largest such share, 1 where a phrase stands, else 0. Null
    texts are empty; rows of equal or null doc_id stay apart; other columns
    are ignored; an empty table gives no rows.
    """
    marker = F.xxhash64(F.lit("\x00 one row a text"))
    templates = template_pairs(docs.sparkSession)
    marked = templates.unionByName(templates.sparkSession.range(1).select(F.lit(-1).alias("tid"), F.lit("").alias("label"), F.lit(0).alias("size"), F.lit(0).alias("at"), marker.alias("hash")))
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(lower_ascii(whole_text()), F.lit(WORD), F.lit(0)).alias("words"),
    )
    n = F.size("words")
    pairs = words.select(
        "doc_id", "row", n.cast("long").alias("n_words"),
        F.concat(F.array(marker), F.when(n > 1, F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.expr("cast(array() as array<bigint>)"))).alias("hashes"),
    )
    # "outer" keeps Spark from adding a filter on the array's size, for which it would be made twice.
    placed = pairs.select("doc_id", "row", "n_words", F.posexplode_outer("hashes").alias("place", "hash"))
    votes = (
        placed.join(F.broadcast(marked), "hash")
        .withColumn("diagonal", F.when(F.col("tid") < 0, F.lit(0)).otherwise(F.col("place") - 1 - F.col("at")))
        .groupBy("row", "tid", "diagonal")
        .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.max("size").alias("size"), F.count("*").alias("votes"), F.min("place").alias("begin"), F.max("place").alias("end"))
    )
    by = Window.partitionBy("row", "tid").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by)
    merged = votes.withColumn("group", F.sum(F.when(step <= gap, 0).otherwise(1)).over(by))
    phrase = (F.col("tid") >= 0) & (F.col("tid") < 1000) & (F.col("votes") == F.col("size"))
    spans = merged.groupBy("row", "tid", "group").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.max("size").alias("size"), F.sum("votes").alias("votes"),
        (F.max("end") - F.min("begin") + 1).alias("length"),
        F.count_if(phrase).alias("base"), F.min(F.when(phrase, F.col("diagonal"))).alias("first"), F.max(F.when(phrase, F.col("diagonal"))).alias("last"),
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.greatest(F.col("size"), F.lit(1)))
    confirmed = (F.col("tid") >= 1000) & (share >= coverage) & (F.col("length") <= stretch * F.col("size") + 1)
    based = F.col("base") > 0
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("base").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        joined(based).alias("base_labels"), joined(based | confirmed).alias("labels"),
        F.coalesce(F.max(F.when(based, 1.0).when(confirmed, share)), F.lit(0.0)).alias("score"),
    ).drop("row")
