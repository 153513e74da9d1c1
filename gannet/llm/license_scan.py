"""Licence scans with Spark's own functions only.

Templates and texts are taken as lower-case words (runs of letters and digits) and their
five-word shingles. For each power of two there is a scale: windows of twice as many shingles,
each half over the next, so that any run of that many shingles lies whole in one window. A
template belongs to the least scale that holds all its shingles. MinHash bands of one row each
retrieve templates for a window; then the share of the template's shingles that the window
holds is counted exactly.

A band can only agree on a shingle that is a template's least one under it, so texts and
windows without any such shingle are passed over before they are hashed: nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
#: A template and its window are at least 1/4 alike, or 1/5 at a containment of 0.8, so all bands
#: miss with a probability of at most 0.75 ** 48, one in a million, or 0.8 ** 48, two in 100,000.
BANDS = 48

# Well-known licence notices.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "apache-2.0-notice": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of each five words in order; none for fewer words."""
    at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE))
    return F.coalesce(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])), F.array().cast("array<bigint>"))


def bands(h: Column) -> Column:
    """For each band the least hash of the shingles, hashed anew by the band's number."""
    return F.array(*[F.array_min(F.transform(h, _hash(b))) for b in range(BANDS)])


def _hash(b: int):
    return lambda x: F.xxhash64(x, F.lit(b))


def _least(h: Column) -> Column:
    """The shingles that are least under some band."""

    def pair(b: int):
        return lambda x: F.struct(_hash(b)(x).alias("m"), x.alias("x"))

    by = [F.array_min(F.transform(h, pair(b)))["x"] for b in range(BANDS)]
    return F.array_distinct(F.array(*by))


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    given = spark.createDataFrame(list(templates.items()), "template string, text string")
    t = given.withColumn("w", words(F.col("text"))).withColumn("h", F.array_distinct(shingles(F.col("w")))).where(F.size("h") > 0)
    scale = F.pow(F.lit(2), F.ceil(F.log2(F.size("w") - SHINGLE + 1))).cast("int")
    return t.select("template", F.col("h").alias("of"), scale.alias("scale"), bands(F.col("h")).alias("bands"), _least(F.col("h")).alias("least"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, containment, first_word and n_words of the best window for each template in a text.

    A row stands for each row of docs and template whose best window holds at least
    `containment` of the template's distinct shingles; of equal windows the first. Repeated rows
    with equal ids come out once; null ids are one id. Null texts, and texts or templates of
    fewer than five words, match nothing. Other columns are left out, so names can't clash.
    """
    spark = docs.sparkSession
    # a fixed few notices: the one thing that is collected and broadcast
    known = _templates(spark, TEMPLATES if templates is None else templates).collect()
    if not known:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words")).where("false")
    gate = F.array(*[F.lit(x) for x in sorted({x for t in known for x in t["least"]})])
    scales = sorted({t["scale"] for t in known})
    sought = spark.createDataFrame([(t["scale"], b, v, t["template"], t["of"]) for t in known for b, v in enumerate(t["bands"])], "scale int, band int, value bigint, template string, of array<bigint>")

    # words are bound once, as a lambda's variable, and explode keeps the filter from being pushed below the hashing
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.transform(F.array(words(F.col(text))), shingles)).alias("h")).where(F.arrays_overlap("h", gate))
    place = F.transform("h", lambda x, i: F.when(F.array_contains(gate, x), i))
    hits = hashed.select("doc_id", "h", F.filter(place, lambda i: i.isNotNull()).alias("hits"))
    windows = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.flatten(F.array(*[F.array(*[F.struct(F.lit(s).alias("scale"), ((F.floor(i / s) - k) * s).cast("int").alias("at")) for k in (0, 1)]) for s in scales])))))
    each = hits.select("doc_id", "h", F.explode(windows).alias("window")).where("window.at >= 0 and window.at < size(h)")
    cut = each.select("doc_id", "window.scale", "window.at", F.slice("h", F.col("window.at") + 1, 2 * F.col("window.scale")).alias("h"))
    banded = cut.select("*", F.posexplode(bands(F.col("h"))).alias("band", "value"))
    met = banded.join(F.broadcast(sought), ["scale", "band", "value"])
    share = F.size(F.array_intersect("of", "h")) / F.size("of")
    found = met.withColumn("containment", share).where(F.col("containment") >= containment)
    # counted before anything is taken for a repeat: rows that share an id may differ in text
    best = F.max(F.struct("containment", -F.col("at"), F.size("h").alias("size"))).alias("best")
    return found.groupBy("doc_id", "template").agg(best).select(
        "doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.col2")).alias("first_word"), (F.col("best.size") + SHINGLE - 1).alias("n_words")
    )
