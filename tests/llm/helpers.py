"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, words: int, kind: str = "en") -> str:
    parts = {"en": ("the", "and", "of", "in", "tion", "re", "er"), "de": ("der", "und", "sch", "ung", "ein", "zu"), "fr": ("le", "la", "que", "eau", "oi", "des")}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words))


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, rng.randint(5, 120), kind), kind, "hot" if i % 2 else f"s{i % 5}"))
    rows += [(n, None, "en", "s1"), (n + 1, "", None, None), (n + 2, " \n\t ", "de", "s2"), (n + 3, prose(rng, 20000), "en", "hot"), (n + 4, "12 34 !!", None, "s1")]
    rows += [rows[0], rows[0], (None, "no id at all here", "en", None), (n + 5, rows[7][1], "en", "hot")]
    return [(*r, len(r[1] or "")) for r in rows]


def frame(spark, rows=None, extra: bool = True):
    df = spark.createDataFrame(documents() if rows is None else rows, COLUMNS)
    if not extra:
        return df
    from pyspark.sql import functions as F

    # names that operators use themselves
    return df.select("*", *(F.lit("x").alias(c) for c in ("score", "host", "id", "part", "queue", "n", "rank", "batch", "spans", "items", "label", "tok")))


def empty(spark):
    return frame(spark, [])
