"""The aligner against planted sequences and against minimizers by definition."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandweave import model
from strandweave.operators import aligner
from strandweave.plans import simplify

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def noisy(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(rng.choice("ACGT") if x < 2 * rate / 3 else c)
        if x > 1 - rate / 3:
            out.append(rng.choice("ACGT"))
    return "".join(out)


def test_minimizers_are_those_of_the_definition(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"n{k}", "".join(rng.choice("ACGTN" if k % 3 == 0 else "ACGT") for _ in range(rng.choice((0, 4, 5, 11, 40, 300))))) for k in range(30)] + [("none", None)]

    def number(w):
        v = 0
        for c in w:
            v = 4 * v + "ACGT".index(c)
        return v * 2654435761 % 4294967291

    want = set()
    for name, s in rows:
        words = [(number(min(s[i : i + 5], rc(s[i : i + 5]))), i) if not set(s[i : i + 5]) - set("ACGT") else None for i in range(len(s or "") - 4)]
        for i in range(max(len(words) - 3, 1) if words else 0):
            some = [w for w in words[i : i + 4] if w] if len(words) >= 4 else [w for w in words if w]
            if some:
                k, p = min(some)
                want.add((name, k, p, s[p : p + 5] <= rc(s[p : p + 5])))
    df = spark.createDataFrame(rows, "name string, sequence string")
    for size in (7, 64, 10_000):
        assert {tuple(r) for r in aligner.minimizers(df, 5, 4, size).collect()} == want


def test_planted_sequences_are_found(spark):
    rng = random.Random(4)
    refs = [(f"x_r{k}", "".join(rng.choices("ACGT", k=20_000))) for k in range(5)]
    queries, truth = [], {}
    for k in range(100):
        name, s = refs[rng.randrange(5)]
        size = rng.randint(400, 3000)
        a = rng.randrange(len(s) - size)
        forward, rate = rng.random() < 0.5, rng.uniform(0.01, 0.05)
        q = noisy(rng, s[a : a + size], rate)
        queries.append((f"q{k}", q if forward else rc(q)))
        truth[f"q{k}"] = (name, forward, a, a + size, rate)
    queries += [(f"un{k}", "".join(rng.choices("ACGT", k=500))) for k in range(20)] + [("empty", ""), ("null", None), ("short", "ACGT")]
    got = aligner.align(spark.createDataFrame(queries, "name string, sequence string"), spark.createDataFrame(refs, "name string, sequence string")).collect()
    unmapped = {r.query_name for r in got if r.is_unmapped}
    assert {f"un{k}" for k in range(20)} | {"empty", "null", "short"} <= unmapped
    found = 0
    for q, (name, forward, a, z, rate) in truth.items():
        mine = [r for r in got if r.query_name == q and not r.is_unmapped and r.reference_name == name and r.is_forward == forward]
        best = max(mine, key=lambda r: r.query_alignment_length, default=None)
        if best and min(z, best.ref_end) - max(a, best.ref_start) > 0.95 * (z - a) and best.nm <= 2 * rate * (z - a) + 10 and best.ref_length == 20_000:
            found += 1
    assert found >= 99
    assert not [r for r in got if not r.is_unmapped and truth[r.query_name][0] != r.reference_name]


def test_repeats_seed_where_nothing_rarer_does(spark):
    rng = random.Random(6)
    unit = "".join(rng.choices("ACGT", k=600))
    refs = [(f"x_r{k}", "".join(rng.choices("ACGT", k=300)) + unit + "".join(rng.choices("ACGT", k=300))) for k in range(12)]
    df = lambda rows: spark.createDataFrame(rows, "name string, sequence string")
    q = df([("q", unit)])
    all_ = aligner.align(q, df(refs)).filter("not is_unmapped")
    few = aligner.seeds(q, df(refs), often=3)
    assert all_.count() == 12 and few.count() < aligner.seeds(q, df(refs)).count() and few.select("ref").distinct().count() == 12


def test_stage_six_runs_without_a_file_of_alignments(spark):
    rng = random.Random(8)
    k = 21
    mid = "".join(rng.choices("ACGT", k=120))
    left, right = (["".join(rng.choices("ACGT", k=400)) for _ in range(2)] for _ in range(2))
    ends = ["".join(rng.choices("ACGT", k=k)) for _ in range(4)]
    head, tail = mid[:k], mid[-k:]
    rows = [("P", "M", ends[0] + left[0] + head, 6.0), ("Q", "M", ends[1] + left[1] + head, 4.0), ("M", "N", mid, 10.0), ("N", "X", tail + right[0] + ends[2], 6.0), ("N", "Y", tail + right[1] + ends[3], 4.0)]
    both = [r for s, d, q, m in rows for r in ((s, d, q, len(q) - k, m), (f"-{d}", f"-{s}", rc(q), len(q) - k, m))]
    g = model.Graph(model.labelled(spark.createDataFrame(both, "src string, dst string, sequence string, length bigint, multiplicity double"), k), k)
    whole = [(f"x_ref{i}", noisy(rng, ends[i] + left[i] + mid + right[i] + ends[2 + i], 0.02)) for i in (0, 1)]
    out, n = simplify.evidence(g, aligner.references(spark.createDataFrame(whole, "name string, sequence string")))
    assert n == 1
    assert {(r.src, r.dst) for r in out.edges.collect()} == {("P", "X"), ("Q", "Y"), ("-X", "-P"), ("-Y", "-Q")}
    assert simplify.evidence(g, aligner.references(spark.createDataFrame([], "name string, sequence string")))[1] == 0
