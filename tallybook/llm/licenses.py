"""License scan by diagonal voting, in DataFrame operations only.

Every run of K consecutive words of every text is hashed and joined to the places of the same run in the
license templates. A hit votes for its diagonal, the text position minus the template position. Votes are
counted per text, template and diagonal; diagonals at most GAP apart (a few words inserted or left out) are
merged; and a merged span is verified: it must hold at least COVERAGE of the template's runs within at most
STRETCH times its length. Verified templates give the method's labels, and their coverage the score.

Words are maximal runs of ASCII letters and digits and of any other non-ASCII characters, A-Z in lower case.
The base labels are plain phrases whose words stand consecutively; each place counts.

Null and empty texts have no words: n_words 0, no labels (empty strings), score 0. Repeated rows each get
the same answer. Null ids are kept. Labels are distinct and sorted. Texts of any length are read whole.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.session import cut

K = 3
GAP = 2
COVERAGE = 0.8
STRETCH = 1.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrase -> label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as licenses and their authors ask for them to be written; label -> texts.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0",
               "you may not use this file except in compliance with the License. You may obtain a copy of "
               "the License at"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met", "Licensed under the BSD License"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike"],
    "gpl": ["licensed under the GNU General Public License",
            "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "reserved": ["All rights reserved"],
}


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


def word_array(text: Column) -> Column:
    """The words of a text. `lower` would turn two letters beyond ASCII into ASCII ones (the Kelvin sign and
    the dotted capital I), so other letters stand in for them."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")),
                     F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(safe), SEPARATORS), "")


def runs(spark: SparkSession, templates: dict[str, list[str]], k: int = K) -> DataFrame:
    """gram, places: where each run of k words stands in the templates. Its size is that of the templates."""
    rows = []
    for label, texts in sorted(templates.items()):
        for n, text in enumerate(texts):
            words = plain_words(text)
            if len(words) < k:
                raise ValueError(f"a template needs at least {k} words: {text}")
            rows += [(words[i:i + k], label, n, i, len(words) - k + 1) for i in range(len(words) - k + 1)]
    flat = spark.createDataFrame(rows, "w array<string>, label string, template int, place int, size int")
    gram = F.xxhash64(*[F.col("w")[i] for i in range(k)])
    return flat.groupBy(gram.alias("gram")).agg(
        F.collect_list(F.struct("label", "template", "place", "size")).alias("places"))


def hits(docs: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """For every row its first position, and every position with a base phrase or a template's run.

    Columns: doc_id, body (a hash of the text), n_words, pos, base (label), places. Texts are split once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"),
                       word_array(F.col("text")).alias("w"))
    n = F.size("w")
    shifted = [F.slice("w", i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(K)]
    spread = rows.select("doc_id", "body", n.cast("long").alias("n_words"),
                         F.posexplode_outer(F.arrays_zip(*shifted)).alias("pos", "z"))
    spread = spread.select("doc_id", "body", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"),
                           *[F.col(f"z.w{i}").alias(f"w{i}") for i in range(K)])
    base = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        match = F.lit(True)
        for i, word in enumerate(phrase.split()):
            match = match & (F.col(f"w{i}") == word)
        base = F.when(match, label).otherwise(base)
    gram = F.when(F.col(f"w{K - 1}").isNotNull(), F.xxhash64(*[f"w{i}" for i in range(K)]))
    spread = spread.select("doc_id", "body", "n_words", "pos", base.alias("base"), gram.alias("gram"))
    joined = spread.join(F.broadcast(runs(spark, templates)), "gram", "left")  # the templates' own size
    return joined.where("pos = 0 or base is not null or places is not null").drop("gram")


def verified(found: DataFrame) -> DataFrame:
    """doc_id, body, label, first, last, coverage: the spans that hold up."""
    key = ["doc_id", "body", "label", "template", "size"]
    votes = (found.where("places is not null").select("doc_id", "body", "pos", F.inline("places"))
             .distinct()  # repeated rows vote once
             .withColumn("diagonal", F.col("pos") - F.col("place")))
    lines = votes.groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"),
                                                F.max("pos").alias("last"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP)
    merged = (lines.withColumn("start", F.coalesce(starts.cast("int"), F.lit(0)))
              .withColumn("span", F.sum("start").over(order))
              .groupBy(*key, "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"),
                                         F.max("last").alias("last")))
    coverage = F.least(F.col("votes") / F.col("size"), F.lit(1.0))
    return (merged.withColumn("coverage", coverage)
            .where((F.col("coverage") >= COVERAGE)
                   & (F.col("last") - F.col("first") + 1 <= F.ceil(F.col("size") * STRETCH)))
            .select("doc_id", "body", "label", "first", "last", "coverage"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Score: 1 with a base label, else the best verified coverage, else 0.
    """
    found = cut(hits(docs, templates or TEMPLATES))
    rows = found.groupBy("doc_id", "body").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("pos") == 0).alias("rows"),
        F.count("base").alias("bases"),
        F.min(F.when(F.col("base").isNotNull(), F.col("pos"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base").isNotNull(), F.col("pos"))).cast("long").alias("last_word"),
        F.collect_set("base").alias("base"))
    spans = verified(found).groupBy(F.col("doc_id").alias("d"), F.col("body").alias("b")).agg(
        F.collect_set("label").alias("extra"), F.max("coverage").alias("coverage"))
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left")
    every = F.array_union("base", F.coalesce("extra", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", (F.col("bases") / F.col("rows")).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("__copy")).drop("__copy")
