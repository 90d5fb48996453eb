from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strandweave.llm import mixing as M

from .helpers import documents, empty, frame


def fair(sizes: dict, weights: dict, repeats: int = 3, total: int | None = None) -> dict:
    """Targets by filling sources up one after the other, in fractions."""
    total = sum(sizes.values()) if total is None else total
    full: set = set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        share = Fraction(rest, max(1, sum(weights[s] for s in weights if s not in full)))
        over = {s for s in sizes if s not in full and share * weights[s] > repeats * sizes[s]}
        if not over:
            return {s: Fraction(repeats * sizes[s]) if s in full else share * weights[s] for s in sizes}
        full |= over


def check(rows, got, keys, repeats=3):
    sizes, weights = defaultdict(int), {}
    words = lambda t: len((t or "").encode().split())
    for r in rows:
        sizes[r[3]] += words(r[1])
    for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        weights[s] = 1 + n % 3
    want = fair(sizes, weights, repeats)
    taken, given = defaultdict(int), Counter()
    for r in got:
        assert 0 <= r.taken <= repeats * r.size
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    # by definition: in each source whole epochs, then by key, the last one in part
    expected = Counter()
    for s in sizes:
        budget = round(float(want[s]))
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for k, doc_id, size in sorted(((k, i, n) for k, i, n, own in keys if own == s), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            once = min(size, rest)
            rest -= once
            expected[doc_id, size, sizes[s], epochs * size + once] += 1
            taken[s] += epochs * size + once
        assert taken[s] == budget
    for r in got:
        given[r.doc_id, r.size, r.source_size, r.taken] += 1
    assert given == expected
    targets = {round(float(t), 6) for t in want.values()}
    assert {round(r.target, 6) for r in got} <= targets


def keys_of(df):
    k = M.sampling_key(M.letters_weight(F.col("text")), 0, "doc_id", "text")
    return [(r.k, r.doc_id, r.n, r.source) for r in df.select(k.alias("k"), "doc_id", M.n_words(F.col("text")).alias("n"), "source").collect()]


def test_every_document_gets_what_the_definition_gives_it(spark):
    rows = documents(n=200) + [(7000 + i, "w " * (1 + i % 9), "en", f"small{i % 7}", 0) for i in range(40)]
    df = frame(spark, rows)
    got = M.mix(df.repartition(5)).collect()
    assert len(got) == len(rows)
    check(rows, got, keys_of(df))
    assert sorted(map(tuple, M.mix(df.repartition(2)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_equal_rows_and_one_source(spark):
    rows = [(None, "a b c", None, "s", 0)] * 30 + [(1, "x y", None, "t", 0)] * 10 + [(k, "m n o p", None, None, 0) for k in range(9)]
    df = frame(spark, rows)
    check(rows, M.mix(df).collect(), keys_of(df))
    alone = [(k, "a b", None, "s", 0) for k in range(9)]
    assert {r.taken for r in M.mix(frame(spark, alone)).collect()} == {2}


def test_empty_tables_and_bad_settings(spark):
    assert M.mix(empty(spark)).count() == 0 and M.mixture(empty(spark)).count() == 0
    nothing = M.mix(frame(spark, [(1, None, None, None, None), (2, " ", None, "s", 0)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        M.mix(frame(spark), repeats=0)


def test_targets_in_fractions(spark):
    rng = random.Random(3)
    sizes = {f"s{k:03d}": int(10 ** rng.uniform(0, 6)) for k in range(300)}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in M.targets(M.numbered(df), F.pmod("number", F.lit(3)) + 1).collect()}
    want = fair(sizes, {s: 1 + n % 3 for n, s in enumerate(sorted(sizes))})
    assert all(abs(got[s] - float(t)) <= 1e-6 * float(t) for s, t in want.items())


def test_heavier_documents_are_drawn_more_often(spark):
    rows = [(k, "w " * 10, "good" if k % 2 else "bad", "big", 0) for k in range(2000)] + [(9000 + k, "w " * 10, "good", "tiny", 0) for k in range(200)]
    quality = F.when(F.col("lang") == "good", 1.0).otherwise(0.25)
    got = M.mix(frame(spark, rows, extra=False), quality=quality, total=8000).join(frame(spark, rows, extra=False).select("doc_id", "lang", "source"), "doc_id").filter("source = 'big'").groupBy("lang").agg(F.sum("taken").alias("n")).collect()
    good, bad = (next((r.n for r in got if r.lang == x), 0) for x in ("good", "bad"))
    assert good > 2.5 * bad > 0


def test_the_mixture_holds_what_was_taken(spark):
    rows = documents(n=80)
    df = frame(spark, rows)
    plan, real = M.mix(df).collect(), M.mixture(df)
    assert real.columns == [*df.columns, "epoch"]
    words = Counter()
    for r in real.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text) or r.n_chars == dict((x[0], x[4]) for x in rows)[r.doc_id]
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.taken
    assert +words == +want
