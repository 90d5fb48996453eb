from __future__ import annotations

import random
import zlib

import numpy as np

from strandweave.llm import quality as Q

from .helpers import empty, frame, prose


def table(n=240):
    rng = random.Random(8)
    good = [(i, prose(rng, rng.randint(20, 100)) + ".", "en", "s", 0) for i in range(n) if i % 3]
    junk = [(i, " ".join([prose(rng, 1)] * rng.randint(20, 90)), "en", "s", 0) for i in range(n) if i % 3 == 0]
    return good + junk


def test_learns_and_compiles_to_one_expression(spark):
    rows = table()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows] + [(3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.quality(df, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = Q.keep_good(df, labels, 0.5)
    assert kept.columns == df.columns and 0.9 * 160 <= kept.count() <= 1.1 * 160


def test_expression_equals_the_sum(spark):
    rng = np.random.default_rng(1)
    x = np.array([Q.statistics(prose(random.Random(i), 5 + i)) for i in range(120)])
    rules = Q.train(x, (x[:, 0] + rng.normal(0, 0.3, 120) > 3.5).astype(float))
    assert rules.rules or rules.linear
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{Q.stat(s)} double" for s in Q.STATISTICS))
    got = [r.p for r in df.select(rules.column().alias("p")).collect()]
    total = np.full(len(x), rules.bias)
    for s, low, high, w in rules.linear:
        total += np.clip(x[:, s], low, high) * w
    for c, w in rules.rules:
        total += w * Q._design(x, [c])[:, 0]
    assert np.allclose(got, Q.sigmoid(total))


def test_awkward_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.quality(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.quality(df, labels.limit(0)).first().score == 0.5 and Q.quality(empty(spark), labels).count() == 0
    assert all(map(np.isfinite, Q.statistics(None) + Q.statistics("") + Q.statistics("\ud800 x")))
