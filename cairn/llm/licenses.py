"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates become word shingles (5 words, lower case, punctuation aside). Templates of fewer than LONG shingles are
indexed by windows of one shingle, whose MinHash is the shingle itself: a shared shingle always collides. Longer ones are
indexed by windows of WIDTH shingles at every offset, in BANDS bands of one MinHash value each, and texts by windows of WIDTH
shingles every STRIDE: an unchanged copy of LONG shingles holds two such windows, which collide with certainty, and a window of
similarity 0.6 collides with probability 1 - 0.4^4 = 0.97. A retrieved template counts if the text holds at least
CONTAINED of its distinct shingles.

Built-in expressions only. The templates are the query set: their keys (two numbers each) are broadcast up to TEMPLATE_KEYS rows, some
16 MB, beyond that the join shuffles. A text's shingles stay in its task; what is joined are its keys.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settled, small

SHINGLE, LONG, WIDTH, STRIDE, BANDS = 5, 8, 4, 2, 4
CONTAINED = 0.8
#: A random word for each band.
FLIPS = [random.Random(k).getrandbits(64) - (1 << 63) for k in range(BANDS)]
TEMPLATE_KEYS = 1_000_000

# Notices, openings and whole texts of common licenses, by SPDX name.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def templates(spark: SparkSession) -> DataFrame:
    """template_id, license, text of the built-in notices."""
    rows = [F.struct(F.lit(i).cast("long").alias("template_id"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(NOTICES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_shingles(df: DataFrame, text: Column, name: str = "h") -> DataFrame:
    """Adds the 64-bit hashes of the text's word shingles, in order; fewer than five words: none."""
    own = [c for c in df.columns if c != name]
    # Words and their hashes are columns of their own, else each shingle would split the text again.
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    df = df.select(*own, settled(words).alias("__w"))
    df = df.select(*own, settled(F.transform("__w", lambda w: F.xxhash64(w))).alias("__w"))
    held = F.transform(F.sequence(F.lit(0), F.size("__w") - SHINGLE), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(SHINGLE)]))
    return df.select(*own, settled(F.when(F.size("__w") >= SHINGLE, held).otherwise(F.array().cast("array<bigint>"))).alias(name))


def _windows(h: Column, stride: int) -> list[Column]:
    """For each band, the MinHash of each window of WIDTH shingles: the least of their hashes as a band's random word flips them."""
    places = F.sequence(F.lit(0), F.size(h) - WIDTH, F.lit(stride))

    def band(k: int) -> Column:
        return F.transform(places, lambda i: F.least(*[F.get(h, i + j).bitwiseXOR(F.lit(FLIPS[k])) for j in range(WIDTH)]))

    return [band(k) for k in range(BANDS)]


def _wide(h: Column, stride: int) -> Column:
    return F.when(F.size(h) >= WIDTH, F.concat(*_windows(h, stride))).otherwise(F.array().cast("array<bigint>"))


def find_licenses(docs: DataFrame, known: DataFrame, text_col: str = "text", broadcast_keys: int = TEMPLATE_KEYS) -> DataFrame:
    """doc_id, template_id, license, containment: the templates that each document holds.

    ``known``: template_id, license, text. A template of fewer than five words has no shingle and is never found. Rows of one
    doc_id count as one document, its containment being that of its best row; a null text holds nothing; a null doc_id is an id.

    Retrieval moves numbers alone: (row, key) meets (key, template). A row is named by its id and a hash of its text. Only texts of rows
    that a template was retrieved for are read again and verified.
    """
    known = with_shingles(known.select("template_id", "license", "text"), F.col("text"))
    keys = F.when(F.size(F.array_distinct("h")) < LONG, F.col("h")).otherwise(_wide(F.col("h"), 1))
    index = known.select("template_id", F.explode(F.array_distinct(keys)).alias("key"))
    rows = docs.select("doc_id", F.col(text_col).alias("__text"), F.xxhash64(F.col(text_col)).alias("__hash")).filter("__text is not null")
    own = with_shingles(rows, F.col("__text")).select("doc_id", "__hash", F.explode(F.concat("h", _wide(F.col("h"), STRIDE))).alias("key"))
    found = own.join(small(index, broadcast_keys), "key").select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__found"), "template_id").distinct()
    found = small(Scratch(docs.sparkSession, "licenses").keep(found, "retrieved"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__found"))
    texts = rows.join(found, same).select("doc_id", "__text", "template_id")
    held = with_shingles(texts, F.col("__text")).select("doc_id", "template_id", "h")
    own = known.select(F.col("template_id").alias("__template"), "license", F.array_distinct("h").alias("own"))
    held = held.join(own, F.col("template_id") == F.col("__template"))
    containment = (F.size(F.array_intersect("own", "h")) / F.size("own")).alias("containment")
    held = held.select("doc_id", "template_id", "license", containment).filter(F.col("containment") >= CONTAINED)
    return held.groupBy("doc_id", "template_id", "license").agg(F.max("containment").alias("containment"))


def license_report(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_templates, licenses (names, sorted, comma-joined; empty if none) for each row of ``docs``."""
    found = find_licenses(docs, known, text_col).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_templates"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    found = found.withColumnRenamed("doc_id", "__id")
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.select("doc_id", F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"), F.coalesce("licenses", F.lit("")).alias("licenses"))
