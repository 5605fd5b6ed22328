"""License notices in texts, with DataFrame operations alone.

Templates are words. They are grouped by length, each group with a window width of its own; texts are
cut into windows of that width that overlap by half, so that every notice lies whole in some window.
A window and a template are candidates if they agree in one band of their MinHash signatures. A band
is one hash function: a window that holds the share ``contained`` of a template's shingles has, by the
widths, a known least similarity to it, and the number of bands follows from the allowed chance of
missing it. Candidates are then verified by exact containment of the template's shingles.

Windows without any template shingle contain no share of a template; they are passed over before any
signature is made, which loses nothing and leaves the costly step to a small part of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinwatch.session import stored_table

# Public license notices as they are commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
SHINGLE, CONTAINED = 5, 0.8
#: The chance that no band of a window and a template it holds agrees.
MISS = 1e-6
_GAPS = "[^0-9a-zA-Z]+"


def license_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _GAPS), lambda w: w != "")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hash of every run of ``size`` words, in order; none for fewer words."""
    hashed = lambda h: F.transform(F.slice(h, 1, F.size(h) - (size - 1)), lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, size)]))
    by_word = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) >= size, hashed(h)))
    return F.coalesce(by_word[0], F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, license, n, tokens``: number, name, and distinct shingles of every template long
    enough to have one. The number is the template's place in the list."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, notice string")
    shingled = rows.select("template", "license", F.array_distinct(shingles(license_words(F.col("notice")))).alias("tokens"))
    return shingled.filter("size(tokens) > 0").select("template", "license", F.size("tokens").alias("n"), "tokens")


def width_of(n: int) -> int:
    """Shingles in the windows for a template of ``n`` shingles: twice the next power of two, so that
    windows that overlap by half hold the template whole wherever it begins."""
    return 2 * (1 << (max(n, 1) - 1).bit_length())


def bands_for(contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands that keep the chance of a miss below ``miss``.

    A template has more than a quarter of its window's width in shingles. The window shares at least
    ``contained`` of them, and together they have at most the width and the rest of the template; one
    hash function agrees with a chance of at least that similarity.
    """
    least = contained * 0.25 / (1 + (1 - contained) * 0.25)
    return math.ceil(math.log(miss) / math.log(1 - least))


def signature(tokens: Column, bands: int) -> Column:
    """The smallest hash of the shingles under each of ``bands`` hash functions."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, b))))


def scan_licenses(
    docs: DataFrame, templates: DataFrame, contained: float = CONTAINED, miss: float = MISS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, license, template, place, containment``: for every row of ``docs`` and template it holds,
    the first window with the greatest containment and the place of the window's first shingle.

    Containment is the share of the template's distinct shingles in the window, ``contained`` at least.
    Null, empty and short texts hold nothing and give no row; a row of ``docs`` that repeats another gives
    its rows again; null ids stay null; texts of any length are read whole. Other columns are not read. An
    empty table, or one without templates, gives no rows.
    """
    spark = docs.sparkSession
    known = stored_table(templates, "license-templates")
    sizes = [r.n for r in known.select("n").distinct().collect()]  # lengths of templates, not rows of the corpus
    if not sizes:
        return spark.createDataFrame([], "doc_id long, license string, template int, place int, containment double")
    widths, bands = sorted({width_of(n) for n in sizes}), bands_for(contained, miss)
    width = F.create_map(*[F.lit(x) for n in sizes for x in (n, width_of(n))])[F.col("n")]
    banded = known.select("template", "license", "n", "tokens", width.alias("width"), F.posexplode(signature(F.col("tokens"), bands)).alias("band", "least"))

    every = sorted(r[0] for r in known.select(F.explode("tokens")).distinct().collect())  # as above
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), shingles(license_words(docs[text_column].cast("string"))).alias("tokens"))
    held = F.filter(F.transform("tokens", lambda t, i: F.when(t.isin(every), i)), lambda i: i.isNotNull())
    # Only texts with some template shingle go on; they are few, and stored once for all widths.
    some = texts.withColumn("held", held).filter("size(held) > 0").withColumn("row", F.monotonically_increasing_id())
    some = stored_table(some, "license-texts")
    starts = lambda w: F.array_distinct(  # noqa: E731  of the two windows over each template shingle
        F.flatten(F.transform("held", lambda i: F.array(F.floor(i / (w // 2)) * (w // 2), F.greatest(F.lit(0), (F.floor(i / (w // 2)) - 1) * (w // 2)))))
    )

    def windows_of(w: int) -> Column:
        cut = lambda s: F.struct(F.lit(w).alias("width"), s.cast("int").alias("place"), F.slice("tokens", s.cast("int") + 1, w).alias("held"))
        return F.transform(starts(w), cut)

    windows = F.flatten(F.array(*[windows_of(w) for w in widths]))
    cut = some.select("row", "doc_id", F.inline(windows)).withColumn("held", F.array_distinct("held"))
    signed = cut.select("row", "doc_id", "width", "place", "held", F.posexplode(signature(F.col("held"), bands)).alias("band", "least"))
    found = signed.join(banded, ["width", "band", "least"]).select("row", "doc_id", "license", "template", "place", "n", F.size(F.array_intersect("held", "tokens")).alias("both"))
    verified = found.filter(F.col("both") >= contained * F.col("n"))
    best = verified.groupBy("row", "template").agg(
        F.first("doc_id").alias("doc_id"), F.first("license").alias("license"), F.first("n").alias("n"), F.max(F.struct("both", (-F.col("place")).alias("place"))).alias("best")
    )
    return best.select(
        "doc_id", "license", "template", (-F.col("best.place")).alias("place"), F.round(F.col("best.both") / F.col("n"), 6).alias("containment")
    )
