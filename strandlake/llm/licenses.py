"""License scans by diagonal voting, in DataFrame functions only.

Every run of GRAM words of a document is hashed; the hashes that some template holds are joined to the
templates' positions. A template that stands in a document gives hits of one offset (document
position minus template position), so hits vote for offset diagonals. A diagonal with all votes is
an exact occurrence; neighbouring diagonals are merged, since a word put in or left out moves the
rest by one, and the merged span is verified by its length and by the share of the template's words that its
grams cover: one word exchanged costs one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.tables import local_table
from strandlake.llm.common import ascii_lower, stored

GRAM = 2
#: Diagonals this far apart or nearer belong to one span.
MAX_SHIFT = 3
#: Share of a template's words that a merged span must cover.
MIN_COVERAGE = 0.75

# Phrases of the contract, and common wordings of license notices.
BASE_TEMPLATES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
NOTICE_TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = "".join(chr(b) for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))


def words(text: Column) -> Column:
    """Array of the lower-cased words of a text; null for a text without words (and for null)."""
    trimmed = F.btrim(ascii_lower(text), F.lit(_SEPARATORS))
    return F.when(trimmed != "", F.split(trimmed, _SEPARATOR))


def template_grams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, grams, at, first, second, hash): each gram of each template."""
    rows = []
    for number, (label, phrase) in enumerate(templates):
        own = phrase.split()
        rows += [(number, label, number < len(BASE_TEMPLATES), len(own) - GRAM + 1, i, own[i], own[i + 1]) for i in range(len(own) - GRAM + 1)]
    grams = local_table(spark, rows, "template int, label string, base boolean, grams int, at int, first string, second string")
    return grams.withColumn("hash", F.xxhash64("first", "second"))


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, places, labels, base_labels, score) for every row of docs (doc_id, text).

    places are the sorted starts of exact base phrases, overlapping ones of different phrases
    included; labels hold those of notices found too; score is the best template's coverage, 0 for
    none. Long texts are scanned whole. Null text counts as empty; repeated rows are scanned each; an empty table gives an empty one;
    other columns are ignored. Keys of one document never exceed its own words.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, BASE_TEMPLATES + (NOTICE_TEMPLATES if notices is None else notices))
    known = [r.hash for r in grams.select("hash").distinct().collect()]  # as many as the templates' grams
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    last = F.size("w") - GRAM
    hit = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)).isin(known)
    starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), hit))
    found = split.select("doc_id", "w", starts.alias("starts"))
    pick = lambda i: F.struct(i.alias("place"), F.get("w", i).alias("first"), F.get("w", i + 1).alias("second"))
    base = stored(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.size("w"), F.lit(0)).cast("long").alias("n_words"), F.transform("starts", pick).alias("hits"),
    ))

    hits = base.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("hash", F.xxhash64("first", "second"))
    matched = hits.join(F.broadcast(grams), ["hash", "first", "second"])
    votes = matched.groupBy("row", "template", "label", "base", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("seen"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = (F.col("diagonal") - F.lag("diagonal").over(own) > MAX_SHIFT).cast("int")
    grouped = votes.withColumn("jump", F.coalesce(jump, F.lit(0))).withColumn("span", F.sum("jump").over(own))
    covered = lambda k: F.transform("seen", lambda at: at + k)
    spans = grouped.groupBy("row", "template", "label", "base", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.concat(*[covered(k) for k in range(GRAM)]))))).alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.collect_list(F.when(F.size("seen") == F.col("grams"), F.col("diagonal"))).alias("exact"),
    )
    coverage = F.col("held") / (F.col("grams") + GRAM - 1)
    is_place = F.col("base") & (F.size("exact") > 0)
    length_fits = F.col("hi") - F.col("lo") + GRAM <= 1.5 * (F.col("grams") + GRAM)
    is_notice = ~F.col("base") & (coverage >= MIN_COVERAGE) & (length_fits | (F.size("exact") > 0))
    checked = spans.where(is_place | is_notice).withColumn("coverage", coverage)
    # of notices that overlap (versions of one license differ in a word) those of the best coverage stay
    ahead = Window.partitionBy("row", "base").orderBy("lo", "hi", "template")
    apart = F.coalesce((F.col("lo") > F.max(F.col("hi") + GRAM - 1).over(ahead.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    chained = checked.withColumn("apart", apart).withColumn("group", F.sum("apart").over(ahead))
    best = F.max("coverage").over(Window.partitionBy("row", "base", "group"))
    verified = chained.withColumn("best", best).where(F.col("base") | (F.col("coverage") == F.col("best")))
    by_row = verified.groupBy("row").agg(
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("base"), F.col("exact"))))).alias("places"),
        F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return base.select("row", "doc_id", "n_words").join(by_row, "row", "left").select(
        "doc_id", "n_words", none("places", "array<int>"), none("labels", "array<string>"), none("base_labels", "array<string>"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
