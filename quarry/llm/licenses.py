"""License scans by diagonal voting, with DataFrame operations only.

Every pair of consecutive words of a text is hashed and joined to the
positions of the same pair in the templates. Hits of one template whose
distance between text and template position is equal lie on one diagonal;
their number is the diagonal's vote. Neighbouring diagonals of a template (a
few words more or less) merge into one span, and spans with enough votes are
verified on the words themselves.

A short phrase is a template of its own: each diagonal on which all of its
pairs voted is a place where it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, maybe_in, table

#: Phrases and labels whose places are counted; fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licenses and their labels; fixed values.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
)
#: Diagonals at most so many words apart merge; a span needs this share of its template's pairs, and of its words.
#: Of a template of fewer than SHORT words, all pairs are needed.
DRIFT, VOTES, AGREEMENT, SHORT = 3, 0.7, 0.7, 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> str:
    """SQL for the words of a text: A-Z lower-cased, runs of digits, letters and code points over 127."""
    return rf"filter(split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), w -> w <> '')"


def pairs_of(words: str) -> str:
    """SQL for the hashes of an array's pairs of neighbours, by position."""
    h = f"transform({words}, w -> xxhash64(w))"
    return f"if(size({words}) < 2, cast(array() as array<bigint>), zip_with(slice({h}, 1, size({words}) - 1), slice({h}, 2, size({words}) - 1), (a, b) -> xxhash64(a, b)))"


def templates(spark: SparkSession, phrases, notices) -> DataFrame:
    """(template, label, base, words): a row for each; their number is that of the given lists."""
    rows = [(k, label, base, text) for k, (text, label, base) in enumerate([*((t, x, True) for t, x in phrases), *((t, x, False) for t, x in notices)])]
    return spark.createDataFrame(rows, "template int, label string, base boolean, text string").select("template", "label", "base", F.expr(words_of("text")).alias("t_words"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, text_hash, n_words) for each row; and the spans found.

    Spans are (id, text_hash, label, base, start, length, coverage), words
    counted from 0. Null texts count as empty and have none; repeated rows
    have one set of spans between them; a null id is an id; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.expr(words_of(text_col)).alias("words"))
    known = templates(spark, phrases, notices)
    places = known.select("template", "base", F.size("t_words").alias("t_size"), F.posexplode(F.expr(pairs_of("t_words"))).alias("t_at", "pair"))
    hits = rows.select("id", "text_hash", F.posexplode(F.expr(pairs_of("words"))).alias("at", "pair")).join(F.broadcast(places), "pair")
    hits = hits.select("id", "text_hash", "template", "base", "t_size", "at", (F.col("at") - F.col("t_at")).alias("diagonal"))
    votes = cut(hits.groupBy("id", "text_hash", "template", "base", "t_size", "diagonal").agg(F.count_distinct("at").alias("votes"), F.min("at").alias("start"), F.max("at").alias("end")))
    labels = F.broadcast(known.select("template", "label", "t_words"))
    phrase = votes.filter("base and votes = t_size - 1").join(labels, "template").select("id", "text_hash", "label", "base", F.col("start").cast("long").alias("start"), F.col("t_size").cast("long").alias("length"), F.lit(1.0).alias("coverage"))
    near = W.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    loose = votes.filter("not base").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT).cast("int"), F.lit(1)))
    merged = loose.withColumn("span", F.sum("new").over(near)).groupBy("id", "text_hash", "template", "t_size", "span").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = cut(merged.filter(F.col("votes") >= F.when(F.col("t_size") < SHORT, 1.0).otherwise(VOTES) * (F.col("t_size") - 1)).filter(F.col("end") - F.col("start") + 2 <= 2 * F.col("t_size")))
    # Only texts that may have a span are dealt: a bitmap of fixed size sorts out most others in the scan.
    some = maybe_in(rows, spans, "id", "text_hash").select("id", "text_hash", "words")
    own = some.join(spans.select("id", "text_hash").distinct().select(F.col("id").alias("i"), F.col("text_hash").alias("h")), F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_semi").dropDuplicates(["id", "text_hash"]).select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "words")
    seen = spans.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).join(labels, "template").withColumn("part", F.expr("slice(words, cast(start + 1 as int), cast(end - start + 2 as int))"))
    agreed = F.size(F.array_intersect("part", "t_words")) / F.size(F.array_union("part", "t_words"))
    notice = seen.withColumn("agreed", agreed).filter(F.col("agreed") >= AGREEMENT).select("id", "text_hash", "label", F.lit(False).alias("base"), F.col("start").cast("long"), (F.col("end") - F.col("start") + 2).cast("long").alias("length"), F.col("agreed").alias("coverage"))
    return rows.select("id", "text_hash", F.size("words").cast("long").alias("n_words")), phrase.unionByName(notice)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    base = F.when(F.col("base"), F.col("start"))
    found = spans.groupBy("id", "text_hash").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("coverage").alias("score")
    ).select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    every = rows.join(found, rows["id"].eqNullSafe(F.col("i")) & (rows["text_hash"] == F.col("h")), "left")
    return every.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
