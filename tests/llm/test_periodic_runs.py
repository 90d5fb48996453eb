from __future__ import annotations

import hashlib
import random
import time
import zlib

from strandweave.llm import periodic_runs as P

from .helpers import documents, empty, frame


def by_definition(words):
    """Runs by comparing every word with the one q before, for every q from the smallest up."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((s, n_, q) for (s, n_), q in out.items())


def answer(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(by_definition(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_are_those_of_the_definition():
    rng = random.Random(4)
    texts = []
    for _ in range(1500):
        n, size = rng.randint(0, 120), rng.choice((1, 2, 2, 3, 5, 30))
        words = [b"%d" % rng.randrange(size) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):  # repeats, also next to and within each other
            a, p, times = rng.randint(0, n), rng.randint(1, 12), rng.randint(2, 9)
            words = words[:a] + words[a : a + p] * times + words[a + rng.randint(0, p) :]
        texts.append(words)
    assert any(P.runs([t])[0] for t in texts)
    assert P.runs(texts) == [by_definition(t) for t in texts]


def test_seeds_are_those_of_every_aligned_block():
    import numpy as np

    rng = random.Random(2)
    for block in (1, 2, 4, 8):
        for start in (0, 1, 5):
            w = [rng.randrange(2) for _ in range(60)]
            i, d = P.seeds(np.array(w), start, block)
            assert sorted(zip(i.tolist(), d.tolist())) == [(a, s) for a in range(60) if (a + start) % block == 0 for s in range(block, 2 * block) if a + s + block <= 60 and w[a : a + block] == w[a + s : a + s + block]]


def test_query_on_awkward_rows(spark):
    rng = random.Random(8)
    rows = documents() + [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 200))), "en", "s1", 0) for k in range(1000, 1120)]
    rows += [(2000, "x " * 5, None, None, 0), (2001, "x\x0bx\tx\nx x\rx", None, None, 0), (2002, "é é é é " * 3, None, None, 0), (-7, "one two " * 50, None, None, 0)]
    got = sorted(map(tuple, P.find(frame(spark, rows).repartition(3)).collect()), key=str)
    assert got == sorted((answer(r[0], r[1]) for r in rows), key=str)
    assert {r[1] > 0 for r in got} == {True, False}
    assert P.find(empty(spark)).count() == 0


def test_long_texts_are_quick():
    rng = random.Random(1)
    same, two = [b"x"] * 300_000, [rng.choice((b"a", b"b")) for _ in range(150_000)]
    short = [w for k in range(20_000) for w in [b"%d" % k, *[b"ha"] * 6]]
    deep = [b"%d" % k for k in range(30_000)] * 5
    began = time.perf_counter()
    assert P.runs([same]) == [[(0, 300_000, 1)]] and P.runs([deep]) == [[(0, 150_000, 30_000)]]
    assert len(P.runs([short])[0]) == 20_000 and len(P.runs([two])[0]) > 1000
    assert time.perf_counter() - began < 60


def test_runs_dropped_from_documents(spark):
    df = frame(spark, [(1, "so so so so so so\n\nit goes", "en", "a", 24), (2, "it  goes\non", "en", "a", 11), (3, None, None, None, None)])
    got = P.dropped_runs(df)
    assert got.columns == df.columns and [(r.text, r.n_chars) for r in got.orderBy("doc_id").collect()] == [("so it goes", 10), ("it  goes\non", 11), (None, None)]
    assert P.dropped_runs(empty(spark)).count() == 0
