"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts are lower-cased and cut into words of letters and digits. A text's
shingles of five words are grouped into windows of ``WINDOW`` shingles that
start every ``STRIDE`` shingles, so each shingle is in two windows and a run of
up to ``WINDOW - STRIDE + 1`` shingles lies whole in one. Templates are cut
alike, but with a window at every shingle; one with fewer shingles is one
window. Each window has ``b`` bands of one row: the least value of b
independent hash functions over its shingles.

Guarantee: a text window that holds t shingles of a template window, and no
template window has more than ``WINDOW``, agrees with it in a band with a
probability of at least t / (2 * WINDOW - t); of t / WINDOW where the template
has just these t. ``bands_for`` sets b so that an occurrence of the shortest
template of at least ``SHORT`` shingles is missed with a probability of at most
``MISSED``; longer ones have more shingles a window, and many windows. A
template of fewer shingles fills too little of a window: each of its shingles is
a key of its own, which a text's shingles meet with certainty, so that it sets no
price for the others. Retrieved (document, template) pairs are verified by the
exact share of the template's distinct shingles that the document holds, at
least ``CONTAINED``.

All of it is DataFrame and SQL functions. Templates may be of any number and
length: their tables are broadcast while they have at most
``BROADCAST_ROWS`` rows, and joined by a shuffle beyond.

Defined results: null and empty texts hold no license; a template with fewer
words than a shingle raises ValueError; a template found many times in a text
counts once; equal rows of documents are one result, as results are by doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

SHINGLE = 5
#: Shingles of a window, and shingles from one window's start to the next.
WINDOW, STRIDE = 8, 4
#: Highest probability of missing an occurrence of a template.
MISSED = 1e-4
CONTAINED = 0.8
#: Templates of fewer distinct shingles are met by their shingles.
SHORT = 5
#: Rows of the templates' tables up to which they are broadcast (under 100 bytes each).
BROADCAST_ROWS = 500_000
#: Candidate pairs up to which they are broadcast for the second pass; they are joined by a shuffle beyond.
BROADCAST_PAIRS = 300_000

# The wordings of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normal(text: Column) -> Column:
    """Words of letters and digits in lower case, a blank between two."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def bands_for(shingles: int, missed: float = MISSED) -> int:
    """Bands that a window with ``shingles`` of a template's, all it has, needs to be missed no more often than that."""
    return max(1, math.ceil(math.log(missed) / math.log(1 - min(shingles, WINDOW - 1) / WINDOW)))


def _windows(df: DataFrame, keep: list[str], stride: int, to_end: bool = False) -> DataFrame:
    """A row for each window of ``text``: ``keep``, and its shingles' hashes s0, s1, ..., null where the text ends before. With
    ``to_end`` windows start up to the last shingle, so that every shingle is among the first ``stride`` of one."""
    words = df.select(*keep, F.split(normal(F.col("text")), " ").alias("__w")).filter(F.size("__w") >= SHINGLE)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__w") - SHINGLE - (0 if to_end else WINDOW - stride), F.lit(0)), F.lit(stride))
    cut = words.select(*keep, F.explode(F.transform(starts, lambda i: F.slice("__w", i + 1, WINDOW + SHINGLE - 1))).alias("__v"))
    hashed = lambda k: F.xxhash64(*(F.get("__v", F.lit(k + i)) for i in range(SHINGLE)))
    return cut.select(*keep, hashed(0).alias("s0"), *(F.when(F.size("__v") >= k + SHINGLE, hashed(k)).alias(f"s{k}") for k in range(1, WINDOW)))


def _keyed(windows: DataFrame, keep: list[str], bands: int, own: int = 0) -> DataFrame:
    """``keep, band_key``: the key of each window in each band, the least value of a hash function of its own over the
    shingles; with ``own``, also the window's first so many shingles themselves, as band 0.

    The bands' numbers are rows, not expressions, so that the generated code is as short for many bands as for few."""
    spread = windows.select("*", F.explode(F.lit(list(range(1 - own, bands + 1)))).alias("__j"))
    value = lambda k: F.xxhash64(F.col(f"s{k}") if k == 0 else F.coalesce(f"s{k}", "s0"), "__j")
    least = F.least(*(value(k) for k in range(WINDOW)))
    if not own:
        return spread.select(*keep, least.alias("band_key"))
    single = F.get(F.array(*(f"s{k}" for k in range(own))), -F.col("__j"))
    return spread.select(*keep, F.when(F.col("__j") > 0, least).otherwise(F.xxhash64(single, F.lit(0))).alias("band_key"))


def _template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, DataFrame, int, bool]:
    """``license, shingle, total`` and ``license, band_key``, the number of bands that the shortest template of ``SHORT``
    shingles or more needs, and whether some have fewer."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    short = rows.filter(F.size(F.split(normal(F.col("text")), " ")) < SHINGLE).select("license").limit(1).collect()
    if short:
        raise ValueError(f"template {short[0][0]!r} has fewer than {SHINGLE} words")
    windows = _windows(rows, ["license"], 1)
    shingles = windows.select("license", F.explode(F.array(*(f"s{k}" for k in range(WINDOW)))).alias("shingle")).filter("shingle is not null").distinct()
    shingles = shingles.join(shingles.groupBy("license").agg(F.count(F.lit(1)).alias("total")), "license")
    least, few = shingles.agg(F.min(F.when(F.col("total") >= SHORT, F.col("total"))), F.count(F.when(F.col("total") < SHORT, 1))).first()
    bands = bands_for(least) if least else 0
    alone = shingles.filter(F.col("total") < SHORT)
    keys = alone.select("license", F.xxhash64("shingle", F.lit(0)).alias("band_key"))
    if bands:
        keys = keys.unionByName(_keyed(windows.join(alone.select("license").distinct(), "license", "left_anti"), ["license"], bands))
    return shingles, keys.distinct(), bands, few > 0


def scan(documents: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, license, n_shared, n_template, containment`` for each license that a document holds."""
    spark = documents.sparkSession
    shingles, keys, bands, short = _template_tables(spark, TEMPLATES if templates is None else templates)
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    docs = documents.select("doc_id", "text").filter(F.length("text") > 0)
    asked = _keyed(_windows(docs, ["doc_id"], STRIDE, short), ["doc_id"], bands, STRIDE * short)
    pairs = saved(asked.join(small(keys), "band_key").select("doc_id", "license").distinct(), "licenses")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    hint = F.broadcast if few else (lambda df: df)
    near = docs.join(hint(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    held = _windows(near, ["doc_id"], WINDOW).select("doc_id", F.explode(F.array(*(f"s{k}" for k in range(WINDOW)))).alias("shingle"))
    met = held.join(small(shingles), "shingle").join(hint(pairs), ["doc_id", "license"], "left_semi")
    counted = met.select("doc_id", "license", "total", "shingle").distinct().groupBy("doc_id", "license", "total").agg(F.count(F.lit(1)).alias("n_shared"))
    out = counted.select("doc_id", "license", "n_shared", F.col("total").alias("n_template"), F.round(F.col("n_shared") / F.col("total"), 6).alias("containment"))
    return out.filter(F.col("n_shared") >= F.lit(contained) * F.col("n_template"))


def oracle(templates: dict[str, str] | None = None, contained: float = CONTAINED) -> str:
    """The same result in DuckDB SQL, by exact containment over all texts."""
    quoted = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    cut = lambda source, key: f"SELECT {key}, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {source}"
    spread = lambda name, key: f"SELECT DISTINCT {key}, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT {key}, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM {name})"
    return f"""WITH t(license, text) AS (VALUES {quoted}), tw AS ({cut('t', 'license')}), ts AS ({spread('tw', 'license')}),
total AS (SELECT license, count(*) AS n FROM ts GROUP BY license), dw AS ({cut('documents', 'doc_id')}), ds AS ({spread('dw', 'doc_id')})
SELECT doc_id, license, count(*) AS n_shared, any_value(n) AS n_template, round(count(*) / any_value(n), 6) AS containment
FROM ds JOIN ts USING (shingle) JOIN total USING (license) GROUP BY doc_id, license HAVING count(*) >= {contained} * any_value(n)"""
