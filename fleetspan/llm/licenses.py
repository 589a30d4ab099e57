"""License scans: MinHash bands retrieve templates, exact shingle containment verifies. [native]

A template of n words is looked for in text windows of 2n words that start every n words, so any
passage of n words lies inside one window. A window can only share a band value with a template
if it holds one of the template's shingles; a hash lookup of all shingles of a text therefore
finds the windows worth a signature without losing a collision. Bands have one row each: a window
that holds the whole template has a Jaccard similarity of at least (n-4)/(2n-4) >= 1/6 with it, at
containment 0.8 it is at least 1/6 too, so that 64 bands miss with probability (5/6)^64 < 1e-5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.common import BROADCAST_BYTES, alnum_words, literal_rows, small_enough, windows_of
from fleetspan.session import ensure_checkpoint_dir

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64

# The short notices by which works name their license.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-short", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, TEMPLATES, ["license_id", "text"])


def _shingles(words: Column, k: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - k + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")))


def _bands(shingles: Column, bands: int) -> Column:
    """One value per band: the smallest of the shingles' hashes under the band's own seed."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))).alias("low")),
    )


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame,
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document and license found: doc_id, license_id, n_windows, containment, first_word.

    ``containment`` is the best share of the template's distinct word shingles in one window,
    ``first_word`` where the first matching window starts (0-based). Null and empty texts, empty
    tables: no rows. Rows that agree in doc_id and text count once; equal ids with other texts are
    put together under the id; a null doc_id is an id like any other. Templates with fewer words
    than a shingle cannot be told from chance and are refused. Other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    known = templates.select("license_id", alnum_words(F.col("text")).alias("words")).distinct()
    short = [r["license_id"] for r in known.where(F.size("words") < shingle).select("license_id").limit(5).collect()]
    if short:
        raise ValueError(f"templates of fewer than {shingle} words: {short}")
    known = known.select("license_id", F.size("words").alias("n"), _shingles(F.col("words"), shingle).alias("theirs"), "words")
    grams = known.select("n", F.explode(windows_of(F.col("words"), shingle)).alias("hash")).distinct()
    sides = known.select("n", "license_id", "theirs", F.explode(_bands(F.col("theirs"), bands)).alias("b")).select(
        "n", "license_id", "theirs", F.col("b.band").alias("band"), F.col("b.low").alias("low")
    )
    if small_enough(known, F.length(F.concat_ws(" ", "theirs")) * bands, broadcast_bytes):
        grams, sides = F.broadcast(grams), F.broadcast(sides)

    # The lookup carries no words: where windows begin is told by place, and the words are cut out of the texts that have any.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), alnum_words(F.col("text")).alias("words"))
    rows = texts.select("doc_id", "text_key", F.size("words").alias("size"), F.posexplode(windows_of(F.col("words"), shingle)).alias("at", "hash"))
    block = F.floor(F.col("at") / F.col("n")).cast("int")
    places = rows.join(grams, "hash").select("doc_id", "text_key", "at", "n", F.explode(F.array(block - 1, block)).alias("block"))
    places = places.where((F.col("block") >= 0) & (F.col("at") + shingle <= (F.col("block") + 2) * F.col("n")))
    places = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("n", (F.col("block") * F.col("n")).alias("first_word"))).alias("places")).checkpoint()
    if small_enough(places, F.size("places") * 8, broadcast_bytes):
        places = F.broadcast(places)
    places = places.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    found = docs.select("doc_id", "text").join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")))
    found = found.select("doc_id", F.col("k").alias("text_key"), alnum_words(F.col("text")).alias("words"), "places")
    cut = F.transform("places", lambda p: F.struct(p["n"].alias("n"), p["first_word"].alias("first_word"), F.array_join(F.slice("words", p["first_word"] + 1, p["n"] * 2), " ").alias("window")))
    windows = found.select("doc_id", "text_key", F.explode(cut).alias("w")).select("doc_id", "text_key", "w.n", "w.first_word", "w.window").distinct()

    signed = windows.withColumn("ours", _shingles(F.split("window", " "), shingle))
    signed = signed.select("doc_id", "text_key", "n", "first_word", "ours", F.explode(_bands(F.col("ours"), bands)).alias("b"))
    signed = signed.withColumns({"band": F.col("b.band"), "low": F.col("b.low")}).drop("b")
    share = F.size(F.array_intersect("ours", "theirs")) / F.size("theirs")
    pairs = signed.join(sides, ["n", "band", "low"]).select("doc_id", "first_word", "license_id", share.alias("share"))
    pairs = pairs.where(F.col("share") >= containment).distinct()
    return pairs.groupBy("doc_id", "license_id").agg(
        F.countDistinct("first_word").alias("n_windows"), F.max("share").alias("containment"), F.min("first_word").cast("long").alias("first_word")
    )
