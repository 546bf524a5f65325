"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts are cut into windows of ``WINDOW`` words, one every ``STEP`` words, so the
windows overlap by a shingle's length less one and every shingle of ``WORDS``
words lies in one of them. A window's band is the least of its shingle hashes
under one of ``BANDS`` orders. A window of four shingles that shares one with a
template has one band in common with probability 1/4, so all ``BANDS`` = 32
miss with probability 0.75 ** 32 = 0.0001; two shared shingles miss with 2e-10.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.shingles import WORDS, let, shingle_hashes, shingle_texts, words_of
from labelweave.llm.steps import saved, text_of

WINDOW, STEP = 8, 4
SHINGLES = WINDOW - WORDS + 1
BANDS = 32
CONTAINMENT = 0.8
SEPARATORS = "[^a-z0-9]+"

# Statements and notices that licenses ask for or are commonly named by.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def orders() -> list[int]:
    """One number for each band; hashes are ordered by their exclusive or with it.

    The first five bits run over all values, so that each part of the hash
    range comes first in one order; the rest is drawn.
    """
    drawn = [int.from_bytes(hashlib.md5(f"order {i}".encode()).digest()[:8], "big") >> 5 for i in range(BANDS)]
    return [(top | (i << 59)) - (1 << 64) * (i >= 16) for i, top in enumerate(drawn)]


def _band(hashes: list[Column], order: Column) -> Column:
    return F.least(*[h.bitwiseXOR(order) for h in hashes])


def _windows(hashes: Column, step: int) -> Column:
    """A window (number, its shingle hashes) every ``step`` words; hashes beyond the end are null."""

    def cut(hashes: Column) -> Column:
        last = F.floor((F.size(hashes) - 1) / step).cast("int")
        at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        found = F.transform(
            at, lambda i: F.struct(i.alias("at"), *[F.get(hashes, i * step + k).alias(f"h{k}") for k in range(SHINGLES)])
        )
        return F.when(F.size(hashes) > 0, found)

    return let(hashes, cut)


def _hashes(window: Column) -> list[Column]:
    return [window[f"h{k}"] for k in range(SHINGLES)]


def template_bands(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, band, value, shingles): the bands of every window of every template, saved.

    Its size depends on the given templates alone, a few words times ``BANDS``.
    Templates of fewer than ``WORDS`` words are refused.
    """
    rows = spark.createDataFrame(list(templates.items()), "license string, template string")
    rows = rows.withColumn("words", words_of(F.col("template"), SEPARATORS))
    if rows.filter(F.size("words") < WORDS).head(1):
        raise ValueError(f"a template needs {WORDS} words")
    rows = rows.withColumn("shingles", F.array_distinct(shingle_texts(F.col("words"))))
    windows = rows.withColumn("window", F.explode(_windows(shingle_hashes(F.col("words")), 1)))
    # A window that starts less than a full window before the end only repeats a part of the one before.
    windows = windows.filter((F.col("window.at") == 0) | F.col(f"window.h{SHINGLES - 1}").isNotNull())
    order = F.explode(F.array(*[F.lit(o) for o in orders()])).alias("band")
    banded = windows.select("license", "shingles", F.size("words").alias("n_words"), "window", order)
    value = _band(_hashes(F.col("window")), F.col("band"))
    return saved(banded.select("license", "shingles", "n_words", "band", value.alias("value")).distinct(), "template-bands")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word) for each document and each license found in it.

    A license is found where at least ``containment`` of its template's word
    shingles stand together: among the words from one template length before a
    retrieved window to one behind it. ``containment`` is the highest such
    share, ``first_word`` the place of the first window that reached the
    threshold. Null and empty texts give no rows, a null doc_id stays null,
    rows with the same doc_id are scanned each and reported together. Texts of
    any length are scanned whole; other columns are ignored.
    """
    spark = docs.sparkSession
    bands = template_bands(spark, templates or TEMPLATES)
    values = [r["value"] for r in bands.select("value").distinct().collect()]  # a few thousand at most
    reach = bands.agg(F.max("n_words")).first()[0]
    numbers = F.array(*[F.lit(o) for o in orders()])

    def retrieved(words: Column) -> Column:
        hit = lambda w: F.exists(numbers, lambda o: _band(_hashes(w), o).isin(values))
        found = F.filter(_windows(shingle_hashes(words), STEP), hit)
        return F.transform(found, lambda w: F.struct(w.alias("window"), _around(words, w["at"] * STEP, reach).alias("near")))

    words = words_of(text_of("text"), SEPARATORS)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(words, retrieved).alias("found"))
    found = found.select("doc_id", F.explode("found").alias("hit")).select("doc_id", "hit.window", "hit.near")
    banded = found.select("doc_id", "window", "near", F.explode(numbers).alias("band"))
    banded = banded.withColumn("value", _band(_hashes(F.col("window")), F.col("band")))
    matched = banded.join(F.broadcast(bands), ["band", "value"])
    share = F.size(F.array_intersect("shingles", shingle_texts(F.col("near")))) / F.size("shingles")
    checked = matched.select("doc_id", "license", share.alias("share"), (F.col("window.at") * STEP).alias("word"))
    kept = checked.filter(F.col("share") >= containment)
    return kept.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("word").cast("long").alias("first_word")
    )


def _around(words: Column, at: Column, reach: int) -> Column:
    """The words from ``reach`` before word ``at`` to ``reach`` behind its window."""
    begin = F.greatest(at - reach, F.lit(0))
    return F.slice(words, begin + 1, at - begin + WINDOW + reach)
