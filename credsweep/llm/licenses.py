"""License scans (native): MinHash bands over overlapping windows, then exact containment.

Texts and templates are runs of words (letters and digits, lower case) and become
sequences of 5-word shingles.  A template of T shingles is looked for in windows
of T + g shingles that begin every g, g a quarter of the template's words, so
that every stretch of its length lies in one window.  A window that contains 80 %
of the template has a Jaccard similarity J of at least 0.8 T / (1.2 T + g) with
it, which is 0.5 or more; with 32 bands of 2 rows they share a band with a
probability of at least 1 - (1 - J^2)^32 > 0.9998.  What the bands retrieve is
verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsweep.llm.common import read

SIZE, CONTAINED = 5, 0.8
BANDS, ROWS = 32, 2

#: Notices by which public licences are granted.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
}


def default_templates(spark: SparkSession) -> DataFrame:
    """``license, text``: the notices above."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(t).alias("text")) for name, texts in TEMPLATES.items() for t in texts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(of_words: Column) -> Column:
    """Hashes of the 5-word runs in order; none for fewer words."""
    return F.when(F.size(of_words) >= SIZE, F.transform(F.sequence(F.lit(1), F.size(of_words) - SIZE + 1), lambda i: F.xxhash64(F.slice(of_words, i, F.lit(SIZE))))) \
        .otherwise(F.array().cast("array<bigint>"))


def band_hashes(of_shingles: Column) -> Column:
    """The hashes of a set's MinHash bands."""
    least = lambda seed: F.array_min(F.transform(of_shingles, lambda s: F.xxhash64(s, seed)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r + 1) for r in range(ROWS)]))


def prepared(templates: DataFrame) -> DataFrame:
    """Templates of at least five words: ``license, template, parts`` (distinct shingles), ``length`` (words), ``bands``."""
    rows = templates.select("license", F.col("text").alias("template"), words(F.col("text")).alias("w")).where(F.size("w") >= SIZE)
    rows = rows.select("license", "template", F.size("w").alias("length"), F.array_distinct(shingles(F.col("w"))).alias("parts"))
    return rows.select("*", band_hashes(F.col("parts")).alias("bands"))


def scan(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and licence that it grants: ``doc_id, license, template, containment, first_word, n_windows``.

    ``containment`` is the largest share of a template's shingles within one
    window, ``template`` the notice that has it (ties: the longest, then by code
    points), ``first_word`` the number (from 0) of the first word of the first
    window that matches, ``n_windows`` how many do.  Rows that share an id are one
    document; null, empty and shorter texts match nothing.

    ``templates`` (``license, text``) is configuration and is collected: its
    shingles become literals, as no window without one of them can share a band
    with a template.  Texts are never shuffled; what is, are matches.
    """
    spark = docs.sparkSession
    known = prepared(templates if templates is not None else default_templates(spark))
    found = known.select("license", "template", "length", "parts").collect()
    by_length: dict[int, set[int]] = {}
    for r in found:
        by_length.setdefault(r["length"], set()).update(r["parts"])
    longs = lambda values: F.array(*map(F.lit, sorted(values))).cast("array<bigint>")
    schema = "doc_id " + docs.schema[id_col].dataType.simpleString() + ", license string, template string, containment double, first_word int, n_windows bigint"
    if not found:
        return spark.createDataFrame([], schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).select("doc_id", shingles(F.col("w")).alias("s"))
    rows = rows.select("doc_id", "s", F.array_intersect("s", longs(set().union(*by_length.values()))).alias("common"))
    kinds = F.array(*[F.struct(F.lit(n).alias("length"), F.lit(max(1, n // 4)).alias("step"), longs(parts).alias("own")) for n, parts in sorted(by_length.items())])
    # an outer explode and a test of what it gives: a filter on an array would move down and compute the shingles again
    rows = rows.withColumn("kind", F.explode_outer(F.when(F.size("common") > 0, kinds))).where(F.col("kind").isNotNull()).select(
        "doc_id", "s", "kind.length", "kind.step", (F.col("kind.length") - SIZE + 1 + F.col("kind.step")).alias("width"),
        F.array_intersect("common", "kind.own").alias("common")).where(F.size("common") > 0)
    # windows begin at multiples of the step; those that hold a template's shingle
    hits = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains("common", F.get("s", i)))
    first = lambda p: F.greatest(F.ceil((p - F.col("width") + 1) / F.col("step")), F.lit(0)).cast("int")
    begins = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(first(p), F.floor(p / F.col("step")).cast("int")))))
    windows = rows.withColumn("n", F.explode_outer(begins)).where(F.col("n").isNotNull()).select(
        "doc_id", "length", (F.col("n") * F.col("step")).cast("int").alias("begin"), F.expr("slice(s, cast(n * step + 1 as int), width)").alias("window"))
    banded = windows.select("*", F.posexplode(band_hashes(F.col("window"))).alias("band", "hash"))
    table = known.select("license", "template", "length", "parts", F.posexplode("bands").alias("band", "hash"))
    pairs = banded.join(F.broadcast(table), ["length", "band", "hash"]) \
        .select("doc_id", "license", "template", "begin", (F.size(F.array_intersect("window", "parts")) / F.size("parts")).alias("containment"), "length") \
        .where(F.col("containment") >= contained)
    each = pairs.groupBy("doc_id", "license", "begin").agg(F.max(F.struct("containment", "length", "template")).alias("best"))
    return each.groupBy("doc_id", "license").agg(F.max("best").alias("best"), F.min("begin").alias("first_word"), F.count(F.lit(1)).alias("n_windows")) \
        .select("doc_id", "license", "best.template", "best.containment", "first_word", "n_windows")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences granted in the documents."""
    return scan(read(spark, sf_dir, "documents"))
