from __future__ import annotations

import math
import random

import pytest

from strandweave.llm import topk


def brute(rows, k=10, every=100):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = {}
    for q in ok:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(ok[q][0], v)), i) for i, vs in ok.items() if i != q for v in vs))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("seed,dim,n", [(1, 5, 700), (2, 3, 40)])
def test_matches_brute_force(spark, seed, dim, n):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((rng.gauss(0, 1), rng.gauss(0, 1), 0.5)) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one common vector, ties
    rows += [(5000, None), (5100, []), (5200, [float("nan")] * dim), (5300, [float("inf")] * dim), (5400, [None] * dim), (None, [1.0] * dim), (5500, [0.0] * dim), (5600, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int".replace(", label int", ""))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows)


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(one).collect()] == [(0, 1, 1, 1024 * 1024)]
    assert topk.top_k(one.limit(0)).count() == 0


def test_large_integers_stay_exact():
    import numpy as np

    q = np.array([[2**30, 3]], np.int64)
    assert topk.scores(q, np.array([[2**30, 5], [1, 1]], np.int64)).tolist() == [[2**60 + 15, 2**30 + 3]]


def test_clustered_vectors_leave_most_rings_unvisited(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 2, (40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(0, 0.05, 16)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert got == want
    index = topk.Index(df)
    asked = sorted(want)
    q = np.array([[math.floor(1024 * x) for x in rows[i][1]] for i in asked])
    kth = np.array([want[i][-1][1] for i in asked], float)
    assert index.visited(q, kth) < 0.3
    assert index.visited(q, np.full(len(q), -np.inf)) == 1


def test_pivots_grow_and_large_vectors_raise(spark):
    big = spark.createDataFrame([(0, [3e9, 3e9]), (1, [3e9, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(big)
    twice = spark.createDataFrame([(0, [1.0, 2.0]), (0, [0.5, 9.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_k(twice).collect()] == [(3, 512 * 1024 + 9 * 1024 * 1024)]
    many = spark.range(40_000).selectExpr("id as vec_id", "array(cast(id % 199 as float), cast(id % 211 as float)) as embedding")
    assert len(topk.Index(many).pivots) == 50
