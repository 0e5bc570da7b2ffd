"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment confirms them.

Texts and templates are word sequences (ASCII lower case; letters, digits and everything beyond ASCII) and their five-word shingles; a
shorter template is one shingle of its own length. Templates fall into classes by their number of shingles, each with windows of
1.5 times the class size that start every half size, so a whole template always lies inside one window. A window holding
``CONTAINED`` of a template has a Jaccard similarity of at least ``least_jaccard``; one value per band and ``BANDS`` bands retrieve it with
a probability over 0.999. A match needs ``CONTAINED`` of the template's shingles in one window.

Only texts with one of the templates' telling words are cut into windows: a telling word stands in more of its template's shingles than a
match may lack, so every match has one. All is DataFrame functions; the template tables are joined by broadcast, their size being checked.

Null and empty texts have no matches. The result has a row per document and template; repeated rows of one doc_id count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "op7_licenses"
SHINGLE = 5
CONTAINED = 0.8
BANDS = 27
#: Most shingles a template set may have to be broadcast; larger sets are joined by shuffle.
BROADCAST_SHINGLES = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# License notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles_of(text: str) -> list[str]:
    words = words_of(text)
    size = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))) if words else []


def telling_word(text: str) -> str:
    """The longest word that stands in more of the template's shingles than a match may lack."""
    found = shingles_of(text)
    counts = Counter(w for s in found for w in set(s.split(" ")))
    sure = [w for w, n in counts.items() if n > (1 - CONTAINED) * len(found) + 1e-9]
    return max(sure, key=lambda w: (len(w), w)) if sure else ""


def size_class(n: int) -> int:
    """Powers of two: a template of n shingles belongs to the least that is not below n."""
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def window_of(size: int, shingle: int = SHINGLE) -> tuple[int, int]:
    """(shingles per window, step) of a class."""
    step = max(1, size // 2)
    return size + step - 1 if size > 1 else 1, step


def least_jaccard(size: int) -> float:
    """Worst similarity of a window that holds enough of a template of this class."""
    window = window_of(size)[0]
    smallest = size // 2 + 1 if size > 1 else 1
    shared = CONTAINED * smallest
    return shared / (smallest + window - shared)


def signature(shingles: Column) -> Column:
    """One minimum per band; each band has a hash function of its own."""
    return F.array(*(F.array_min(F.transform(shingles, _in_band(band))) for band in range(BANDS)))


def _in_band(band: int):
    return lambda h: F.xxhash64(h, F.lit(band))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, length, size, shingles, n): length is the words in a shingle, size the class."""
    rows = [(name, min(SHINGLE, len(words_of(text))), size_class(len(shingles_of(text))), shingles_of(text)) for name, text in sorted(templates.items()) if words_of(text)]
    made = spark.createDataFrame(rows, "template string, length int, size int, parts array<string>")
    return made.select("template", "length", "size", F.transform("parts", lambda p: F.xxhash64(p)).alias("shingles"), F.size("parts").alias("n"))


def text_words(text: Column) -> Column:
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(plain, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "), " "), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: an expression inside a lambda would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(words: Column, length: int, sizes: list[int]) -> Column:
    """Windows of all classes for one shingle length: structs (length, size, start, held, mark); ``start`` counts words.

    Each band's hash function is applied once per shingle; a window's mark is the band's minimum over its slice.
    """
    n = F.size(words) - length + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, length), " ")))

    def of_class(all_: Column, turned: Column, size: int) -> Column:
        width, step = window_of(size)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
        mark = lambda s: F.transform(turned, lambda band: F.array_min(F.slice(band, s + 1, width))).alias("mark")
        return F.transform(starts, lambda s: F.struct(F.lit(length).alias("length"), F.lit(size).alias("size"), s.alias("start"), F.slice(all_, s + 1, width).alias("held"), mark(s)))

    def cut(all_: Column) -> Column:
        turned = F.array(*(F.transform(all_, _in_band(band)) for band in range(BANDS)))
        return bound(turned, lambda t: F.concat(*(of_class(all_, t, size) for size in sizes)))

    # Texts with fewer words than a shingle have no window.
    return F.filter(bound(hashes, cut), lambda w: n > 0)


def matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, template, containment, start, windows): best containment, first word of the first window that matches, windows that do."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    table = template_table(spark, templates)
    small = sum(len(shingles_of(t)) for t in templates.values()) <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda df: df)
    tells = sorted({telling_word(t) for t in templates.values() if words_of(t)})
    text = F.col("text")
    if "" not in tells:
        docs = docs.filter(text.rlike("(?i)" + "|".join(map(re.escape, tells)))) if tells else docs.filter(F.lit(False))
    kinds = sorted({(min(SHINGLE, len(words_of(t))), size_class(len(shingles_of(t)))) for t in templates.values() if words_of(t)}) or [(SHINGLE, 1)]
    # One list of windows per class, then one row per window.
    lengths = sorted({length for length, _ in kinds})
    lists = bound(text_words(text), lambda words: F.concat(*(windows(words, length, [s for n, s in kinds if n == length]) for length in lengths)))
    one = docs.select("doc_id", F.explode(lists).alias("w")).select("doc_id", "w.*")
    bands = one.select("doc_id", "length", "size", "start", "held", F.posexplode("mark").alias("band", "value"))
    known = table.select("template", "length", "size", "n", "shingles", F.posexplode(signature(F.col("shingles"))).alias("band", "value"))
    met = bands.join(hint(known), ["length", "size", "band", "value"])
    contained = F.size(F.array_intersect("held", "shingles")) / F.col("n")
    checked = met.select("doc_id", "template", "start", contained.alias("containment")).filter(F.col("containment") >= CONTAINED)
    return checked.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("start"), F.count_distinct("start").alias("windows"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in every document."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
