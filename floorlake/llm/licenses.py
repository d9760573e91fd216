"""License scans by diagonal voting: word k-grams of texts joined to template positions, votes by offset, spans verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floorlake.llm.common import let, text_key
from floorlake.staging import broadcast_if_small, scratch, staged

#: Templates of so many words or more are looked up by k-grams of so many words, shorter ones by a single k-gram.
K = 4
#: Places are looked up by the hash of so many words, the first ones of a k-gram, or fewer where a template has fewer.
LEAD = 2
#: Diagonals that are at most so far apart belong to one span: words left out or put in move a match to a neighbouring one.
SLACK = 4
#: Places are looked up by the hash of so many words, the first ones of a k-gram, or fewer where a template has fewer.
LEAD = 2
#: A span is a match where its k-grams cover so much of the template's words.
MIN_SHARE = 0.7
#: Templates of fewer words say something else where a word differs ("version 2"), so all their words must be covered.
SHORT = 12
#: ... and it is at most so many times as long as the template.
MAX_STRETCH = 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases whose every place counts, with their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

# Public license notices, with the labels that a match adds.
NOTICES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
]
TEMPLATES = "template_id int, label string, text string, phrase boolean"


def scan_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of all other characters beyond ASCII; none for a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def default_templates(spark: SparkSession) -> DataFrame:
    """The phrases and notices above as a table of literals."""
    rows = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    one = lambda i, r: F.struct(F.lit(i).alias("template_id"), *[F.lit(v).alias(c) for c, v in zip(("label", "text", "phrase"), r, strict=True)])
    return spark.range(1).select(F.inline(F.array(*[one(i, r) for i, r in enumerate(rows)])))


def count_words(text: Column) -> Column:
    """How many words :func:`scan_words` finds; only the ends of a split text can be empty."""
    ends = lambda w: F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == "")).cast("int")
    return let(F.split(F.coalesce(text, F.lit("")), CASED_BREAK), ends).cast("long")


def _gram(w: Column, i: Column, k: Column) -> Column:
    return F.array_join(F.slice(w, i + 1, k), " ")


def _places(texts: DataFrame, lead: int) -> DataFrame:
    """``texts`` with words ``w``, at every place i from 0 that has ``lead`` words, and their hash h."""
    at = texts.filter(F.size("w") >= lead).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - lead)))
    return at.withColumn("h", F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(lead)]))


def template_grams(templates: DataFrame, lead: int) -> DataFrame:
    """h, k, gram, template_id, t: the k-grams of every template at their positions ``t`` from 0, with n, the template's number of words.

    k is the template's number of words, ``K`` at most; h the hash of a gram's first ``lead``
    words, no more than the shortest template has. Templates without words have none.
    """
    w = templates.select("template_id", scan_words(F.col("text")).alias("w"))
    k = F.least(F.size("w"), F.lit(K))
    own = _places(w.filter(F.size("w") > 0), lead).filter(F.col("i") <= F.size("w") - k)
    return own.select("h", k.alias("k"), _gram(F.col("w"), F.col("i"), k).alias("gram"), "template_id", F.col("i").alias("t"), F.size("w").alias("n"))


def _hits(docs: DataFrame, grams: DataFrame, lead: int) -> DataFrame:
    """key, template_id, n, k, t, d: word places of texts (by ``key``) that hold a template's k-gram at its position t, d being the offset between both.

    All rolling hashes of ``lead`` words are joined, one lookup a place for k-grams of every size;
    then all k words are compared. While the templates fit a broadcast they are compared in
    place; beyond, the words ahead are shuffled with the hash.
    """
    at = _places(docs.select(text_key(F.col("text")).alias("key"), scan_words(F.col("text")).alias("w")), lead)
    small = broadcast_if_small(grams)
    if small is grams:
        at, said = at.select("key", "i", "h", F.slice("w", F.col("i") + 1, K).alias("ahead")), _gram(F.col("ahead"), F.lit(0), F.col("k"))
    else:
        said = _gram(F.col("w"), F.col("i"), F.col("k"))
    # not an equality, or words would be put together for every place instead of those that meet
    same = F.array_contains(F.array("gram"), said)
    met = at.join(small.withColumnRenamed("h", "__h"), (F.col("h") == F.col("__h")) & same)
    return met.select("key", "template_id", "n", "k", "t", (F.col("i") - F.col("t")).alias("d"))


def diagonals(hits: DataFrame) -> DataFrame:
    """key, template_id, n, k, d, at: the template positions that vote for each offset. Copies of a text vote once."""
    return hits.groupBy("key", "template_id", "n", "k", "d").agg(F.collect_set("t").alias("at"))


def spans(votes: DataFrame) -> DataFrame:
    """key, template_id, first, last, share of each verified span: neighbouring offsets merged.

    share: the template's words that lie in k-grams which the span has at a merged offset.
    """
    order = Window.partitionBy("key", "template_id").orderBy("d")
    apart = F.col("d") - F.lag("d").over(order) > F.least(F.lit(SLACK), F.col("n") - 1)
    named = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    named = named.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = named.select("key", "template_id", "n", "span", F.explode("at").alias("t"), "d", "k")
    held = one.groupBy("key", "template_id", "n", "span").agg(
        F.min(F.col("d") + F.col("t")).alias("first"),
        F.max(F.col("d") + F.col("t") + F.col("k") - 1).alias("last"),
        F.collect_set("t").alias("at"),
        F.max("k").alias("k"),
    )
    # in order of positions, each k-gram adds the words that the one before it didn't reach
    step = lambda s, t: F.struct((t + F.col("k")).alias("upto"), (s["n"] + F.least(F.col("k"), t + F.col("k") - s["upto"])).alias("n"))
    covered = F.aggregate(F.array_sort("at"), F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step, lambda s: s["n"])
    share = covered / F.col("n")
    good = held.withColumn("share", share).filter((F.col("share") >= F.when(F.col("n") < SHORT, 1.0).otherwise(MIN_SHARE)) & (F.col("last") - F.col("first") + 1 <= F.col("n") * MAX_STRETCH))
    return good.select("key", "template_id", "first", "last", "share")


def license_scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every text.

    Templates (``TEMPLATES``) marked ``phrase`` count at every place where all their words stand:
    n_base places, the first and last word of which first_word and last_word say (null without
    any). The others add their labels where a span covers ``MIN_SHARE`` of their words, or all of fewer than ``SHORT``. score is
    the highest share of a span or phrase, 0 without any; ``spans`` lists them as (first word, last
    word, label, share), in order. A null text is empty; equal texts are looked up once, so
    repeated rows and rows that share an id or have none each get their text's result. Extra
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    with scratch(spark):
        templates = staged(templates.select("template_id", "label", "text", "phrase"), "templates", keep=True)
        shortest = templates.select(F.size(scan_words(F.col("text"))).alias("n")).filter("n > 0").agg(F.min("n")).first()[0]
        lead = min(shortest or K, LEAD)
        grams = staged(template_grams(templates, lead), "grams")
        votes = staged(diagonals(_hits(docs, grams, lead)), "votes", keep=True)
    kinds = templates.select("template_id", "label", "phrase")
    by_votes = votes.join(broadcast_if_small(kinds), "template_id")
    places = by_votes.filter(F.col("phrase") & (F.size("at") == F.col("n") - F.col("k") + 1)).select(
        "key", "label", "phrase", F.col("d").alias("first"), (F.col("d") + F.col("n") - 1).alias("last"), F.lit(1.0).alias("share")
    )
    found = spans(by_votes.filter(~F.col("phrase")).drop("label", "phrase")).join(broadcast_if_small(kinds), "template_id").select("key", "label", "phrase", "first", "last", "share")
    base = F.col("phrase")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = places.union(found).groupBy("key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed("label").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"),
    )
    ids = docs.select("doc_id", count_words(F.col("text")).alias("n_words"), text_key(F.col("text")).alias("key"))
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    filled = ids.join(broadcast_if_small(staged(by_text, "licenses")), "key", "left").withColumns({c: F.coalesce(c, v) for c, v in empty.items()})
    return filled.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
