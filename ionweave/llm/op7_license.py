"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined to the hashes of template positions
(k = 2 for the short phrases, k = 3 for the notices). A match at document word i and template
word j votes for the diagonal i - j. Votes are summed by diagonal, neighbouring diagonals (words
dropped or put in) are merged, and a span is verified by the share of the template's k-grams that
it holds and by how densely it holds them.

The templates are the constants below, so their join table has a fixed size and is broadcast.

Defined cases: null and empty texts have no words and no labels; a phrase that occurs several
times counts at each place; overlapping notices of several licenses all report; a very long text
is one row whose words are streamed; repeated rows are judged each; an empty table gives an empty
result; other columns, whatever their names, are neither read nor returned.

Everything here is a DataFrame or SQL function.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, table

# The phrases and labels of the contract.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Sentences of the public notices of common licenses.
NOTICES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)
K_PHRASE, K_NOTICE = 2, 3
#: Diagonals at most this far apart are one span.
NEIGHBOUR = 3
#: Least share of a notice's k-grams, and least votes for each word of the span.
COVER, DENSITY = 0.6, 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_keys(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k_phrase=K_PHRASE, k_notice=K_NOTICE) -> tuple[DataFrame, DataFrame]:
    """(key, at): where each k-gram stands; at is an array of (template, its label, base, j, k-grams)."""
    def one(k, rows):
        df = spark.createDataFrame(rows, "t int, label string, base boolean, j int, grams int, w array<string>")
        key = F.xxhash64(*(F.element_at("w", i + 1) for i in range(k)))
        return df.groupBy(key.alias("key")).agg(F.collect_list(F.struct("t", "label", "base", "j", "grams")).alias("at"))

    out, t = [], 0
    for k, base, texts in ((k_phrase, True, phrases), (k_notice, False, notices)):
        rows = []
        for label, text in texts:
            w = re.findall("[0-9a-z]+", text.lower())
            rows += [(t, label, base, j, len(w) - k + 1, w[j : j + k]) for j in range(len(w) - k + 1)]
            t += 1
        out.append(one(k, rows))
    return out[0], out[1]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER, density: float = DENSITY) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels
    (arrays), score and spans (array of label, first word, last word, share of its k-grams)."""
    spark = docs.sparkSession
    two, three = template_keys(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w").cast("bigint")
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"), F.slice("w", F.lit(3), F.greatest(F.size("w"), F.lit(1))).alias("c"))
    words = rows.select("row", "id", n.alias("n_words"), F.posexplode_outer(zipped).alias("i", "g"))
    g = words.select("row", "id", "n_words", "i", F.xxhash64("g.a", "g.b").alias("k2"), F.xxhash64("g.a", "g.b", "g.c").alias("k3"))
    g = g.join(F.broadcast(two.select(F.col("key").alias("k2"), F.col("at").alias("at2"))), "k2", "left")
    g = g.join(F.broadcast(three.select(F.col("key").alias("k3"), F.col("at").alias("at3"))), "k3", "left")
    # The first word's row stands for its text, whether or not anything matches in it.
    g = g.where("at2 IS NOT NULL OR at3 IS NOT NULL OR i = 0 OR i IS NULL")
    none = F.array().cast("array<struct<t:int,label:string,base:boolean,j:int,grams:int>>")
    g = g.select("row", "id", "n_words", "i", F.explode_outer(F.concat(F.coalesce("at2", none), F.coalesce("at3", none))).alias("m"))
    votes = g.groupBy("row", "id", "n_words", "m.t", "m.label", "m.base", "m.grams", (F.col("i") - F.col("m.j")).cast("bigint").alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("i").alias("lo"), F.max("i").alias("hi"))

    # Neighbouring diagonals of one notice become one span; a phrase must stand on one diagonal.
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    gap = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR), 1).otherwise(0)
    spans = votes.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("span", F.sum("gap").over(by))
    spans = spans.groupBy("row", "id", "n_words", "t", "label", "base", "grams", "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("diagonal"))
    share = F.when(F.col("grams").isNotNull(), F.least(F.lit(1.0), F.col("votes") / F.col("grams"))).otherwise(0.0)
    dense = F.col("votes") / (F.col("hi") - F.col("lo") + 1)
    spans = spans.withColumn("share", share).withColumn("good", F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise((share >= cover) & (dense >= density)))
    base = F.col("good") & F.col("base")
    found = F.when(F.col("good"), F.col("label"))
    out = spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(found)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.col("share"))), F.max(F.when(~F.col("base"), F.col("share") * 0.5)), F.lit(0.0)).alias("score"),
        F.collect_list(F.when(F.col("good"), F.struct("label", "lo", (F.col("hi") + F.when(F.col("base"), K_PHRASE - 1).otherwise(K_NOTICE - 1)).alias("hi"), "share"))).alias("spans"),
    )
    return out.drop("row").withColumnRenamed("id", id_col)


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents")).drop("spans")
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
