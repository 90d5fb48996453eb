from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from strandweave.llm import ngram_join as N
from strandweave.llm.components import components

from .helpers import documents, empty, frame, prose


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset()


def brute(rows):
    s = defaultdict(list)
    for i, t in rows:
        s[i].append(sets(t))
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in s[x] for b in s[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1) + "x"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = prose(rng, rng.randint(3, 90))
        for _ in range(rng.randint(1, 7)):
            rows.append(changed(rng, base, rng.randint(0, 3)))
    passage = prose(rng, 60)
    rows += [passage + " " + prose(rng, rng.randint(1, 14)) for _ in range(30)]  # a passage that makes up most of many texts
    chain = prose(rng, 100).split()
    rows += [" ".join(chain[k : k + 60]) for k in range(0, 30, 3)]  # neighbours link, ends don't
    rows += ["", None, "one", "ONE", "one two", "a b c d", "A b  c\td"]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    df = frame(spark, [(i, t, None, None, None) for i, t in pairs])
    got = {r.doc_id: r for r in N.ngram_join(df).collect()}
    want = brute(pairs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(sets(t)) for i, t in pairs}


def test_awkward_rows(spark):
    rows = documents()
    df = frame(spark, rows)
    got = N.ngram_join(df).collect()
    want = brute([(r[0], r[1]) for r in rows if r[0] is not None])
    assert len(got) == len(rows) and all(r.doc_id is None or r.component_id == want[r.doc_id] for r in got)
    kept = N.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] is None or want[r[0]] == r[0]}
    assert N.ngram_join(empty(spark)).count() == 0


def test_prefix_holds_a_common_token():
    for n in range(1, 300):
        assert N.prefix_length(n) == n - -(-85 * n // 100) + 1 and 1 <= N.prefix_length(n) <= n


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_rows_that_repeat_a_doc_id_link_by_any_of_their_texts(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(70)]
    near, far = words[:60], words[:57] + ["x", "y", "z", "u", "v", "t", "s"]
    third = words[1:60]
    rows = [(5, " ".join(near)), (5, " ".join(far) + " " + prose(rng, 30)), (2, " ".join(third)), (9, None), (9, "only these words here"), (7, "only these words here"), (8, "")]
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    want = brute(rows)
    got = N.ngram_join(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want and want[5] == 2
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_blocks_and_chunks_lose_no_pair(spark):
    rng = random.Random(4)
    entries = []
    for k in range(400):
        n = rng.randint(1, 60)
        pos = rng.randint(0, N.prefix_length(n) - 1)
        entries.append((rng.randint(0, 3), bytes([k // 256, k % 256]), n, int(N.reach(n, pos)), bytes([rng.randint(0, 5)])))
    df = spark.createDataFrame(entries, "tok long, id binary, n int, reach int, comp binary")
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in entries for y in entries if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and x[2] <= y[3] and y[2] <= x[3]}
    for chunk in (3, 1000):
        assert {(bytes(r.a), bytes(r.b)) for r in N.meetings(df, chunk=chunk).collect()} == want


def test_reach_is_the_largest_partner_that_a_position_allows():
    for share in (80, 85):
        for n in range(1, 60):
            for pos in range(N.prefix_length(n, share)):
                fits = [m for m in range(1, 200) if (100 + share) * min(n - pos, m) >= share * (n + m)]
                assert max(fits, default=0) <= N.reach(n, pos, share) and N.reach(n, pos, share) == max((m for m in range(1, 400) if (100 + share) * (n - pos) >= share * (n + m)), default=N.reach(n, pos, share))


def test_hashes_tell_words_apart():
    rng = random.Random(2)
    made = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 300))) for _ in range(3000)} | {"a" * k for k in range(1, 400)}
    text = " ".join(sorted(made))
    h = N.word_hashes(text)
    assert len(h) == len(made) == len(set(h.tolist())) and (N.word_hashes("Ab " + text)[1:] == h).all()
    thue = ["ab", "ba"]
    for _ in range(11):
        thue = [thue[0] + thue[1], thue[1] + thue[0]]
    a, b = N.word_hashes(" ".join(thue))
    assert a != b
