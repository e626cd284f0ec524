"""Licence notices and texts in documents, by MinHash bands over overlapping windows; column functions only.

Words are runs of a-z and 0-9 of the lower-cased text; shingles are three words, hashed; fewer words are one
shingle as a whole. Templates may be of any length. They are put into classes by their number of shingles:
class c (1, 2, 4 and so on, as far as the templates go) holds those of more than c / 2 and at most c. For each
class that has templates a document is cut into windows of 2c shingle positions that begin at every c-th, so any
stretch of c lies whole in some window, and a template found there has a Jaccard similarity of more than a
quarter with it. Each of ``BANDS`` bands is the minimum of one hash function; a window and a template meet with
probability 1 - (1 - J)^BANDS, which is 0.9999 for a quarter. Windows that meet a template are verified by the
exact share of the template's shingles that they hold.

A window that holds the share asked for of a template's shingles holds one of any few more of them than may be
missing; only documents and windows with one of those go on. This loses nothing.

Defined cases: a missing text counts as empty; a text without words has no shingle; a template of one or two
words is found in documents that are no more than it, one without words nowhere; every document is returned,
without a match with no licences; rows that repeat a ``doc_id`` share what is found; templates are given by the
caller, and their numbers are the only broadcast.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = 32
#: Share of a template's shingles that a window must hold.
CONTAINMENT = 0.8


def classes_up_to(largest: int) -> list[int]:
    """Powers of two up to the first that is not below ``largest``."""
    return [1 << k for k in range(max(largest - 1, 0).bit_length() + 1)]



#: Notices that stand for a licence (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("MIT", "Released under the MIT License"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _hashes(text: str) -> str:
    """SQL for the shingle hashes of a text in order; the words are worked out once."""
    words = f"array_remove(split(lower(coalesce({text}, '')), '[^a-z0-9]+'), '')"
    shingle = "xxhash64(w[i], w[i + 1], w[i + 2])"
    return (
        f"element_at(transform(array({words}), w -> CASE WHEN size(w) = 0 THEN cast(array() as array<bigint>) "
        f"WHEN size(w) < 3 THEN array(xxhash64(concat_ws(' ', w))) "
        f"ELSE transform(sequence(0, size(w) - 3), i -> {shingle}) END), 1)"
    )


def _minima(hashes: str) -> str:
    """SQL for an array of the minimum of each band's hash function."""
    return f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform({hashes}, h -> xxhash64(h, b))))"


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """``license, grams, class``: distinct shingles of each template, in order of their hashes, and its class."""
    rows = spark.createDataFrame([(n, t) for n, t in templates], "license string, notice string")
    known = rows.select("license", F.expr(f"array_sort(array_distinct({_hashes('notice')}))").alias("grams"))
    of_class = F.pow(F.lit(2), F.ceil(F.round(F.log2(F.size("grams").cast("double")), 9))).cast("int")
    return known.filter(F.size("grams") > 0).withColumn("class", of_class)


def find_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_licenses, licenses, containment``: names found, sorted and comma-joined, and the best share."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    given = known.select("grams", "class").collect()  # templates that the caller holds
    signs = sorted({g for row in given for g in row.grams[: len(row.grams) - ceil(containment * len(row.grams) - 1e-9) + 1]})
    any_of = F.from_json(F.lit(str(signs)), "array<bigint>")  # a constant, however many there are
    used = sorted({row["class"] for row in given}) or [1]
    hashed = docs.select("doc_id", F.expr(_hashes("text")).alias("hashes")).filter(F.arrays_overlap("hashes", any_of))
    windows = (
        hashed.withColumn("class", F.explode(F.array(*[F.lit(c) for c in used])))
        .withColumn("start", F.explode(F.expr("sequence(0, size(hashes) - 1, class)")))
        .select("doc_id", "class", F.expr("array_distinct(slice(hashes, start + 1, 2 * class))").alias("window"))
        .filter(F.arrays_overlap("window", any_of))
    )
    banded = windows.select("doc_id", "class", "window", F.posexplode(F.expr(_minima("window"))).alias("band", "least"))
    keys = known.select("license", "grams", "class", F.posexplode(F.expr(_minima("grams"))).alias("band", "least"))
    met = banded.join(F.broadcast(keys), ["class", "band", "least"])
    share = F.size(F.array_intersect("window", "grams")) / F.size("grams")
    found = (
        met.withColumn("share", share).filter(F.col("share") >= containment)
        .groupBy("doc_id", "license").agg(F.max("share").alias("share"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_list("license")).alias("names"), F.max("share").alias("containment"))
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )
