from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from strandweave.llm import divergence as D

from .helpers import documents, empty, frame


def by_definition(rows, least=10, top=10):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs:
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        of = lambda c: (lambda size: {t: 1 + 10**9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        groups = {s: of(c) for (k, s), c in n.items() if k == lang}
        whole = of(sum((c for (k, _), c in n.items() if k == lang), Counter()))
        for s, p in groups.items():
            pairs = sorted(((-sum(f(p[t], q[t]) for t in kept), o.encode(), o) for o, q in groups.items() if o != s))
            terms = sorted((-f(p[t], whole[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[t] > whole[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def corpus(groups, seed=1, n=400):
    rng = random.Random(seed)
    common, rare = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(60)], ["R" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(120)]
    rows = []
    for i in range(n):
        g = rng.randrange(groups)
        words = rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rare[g % 90 : g % 90 + 12], k=rng.randint(0, 25))
        rows.append((i, " ".join(words), rng.choice(("en", "en", "de", None)), f"src{g}" if g else None, 0))
    return rows


@pytest.mark.parametrize("groups, block, light, tile", [(20, 64, 8, 4096), (23, 5, 3, 7), (3, 2, 0, 10), (12, 4, 99, 10)])
def test_every_value_is_that_of_the_definition(spark, monkeypatch, groups, block, light, tile):
    for name, value in (("BLOCK", block), ("LIGHT", light), ("TILE_TERMS", tile), ("TILE_SHARES", 40), ("FLUSH", 500), ("PIECE", 50)):
        monkeypatch.setattr(D, name, value)
    rows = corpus(groups)
    got = sorted(map(tuple, D.audit(frame(spark, rows).repartition(4)).collect()))
    assert got == by_definition(rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_sql_and_awkward_rows(spark):
    rows = corpus(7) + documents() + [(k, None, "xx", f"s{k}", 0) for k in range(3)]
    df = frame(spark, rows)
    got = sorted(map(tuple, D.audit(df).collect()))
    assert got == by_definition(rows)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toPandas())
    assert sorted(con.sql(D.oracle()).fetchall()) == got
    assert {r[4] for r in got if r[0] == "xx"} == {0} and not [r for r in got if r[0] == "xx" and r[2] == "term"]
    assert D.audit(empty(spark)).count() == 0


def test_shares_of_huge_counts(spark):
    rows = [(4_000_000_000_000_000, 9_000_000_000_000_000, 12345), (0, 9_000_000_000_000_000, 7), (5, 5, 0), (0, 0, 0)]
    got = spark.createDataFrame(rows, "n long, size long, v long").select(D.share("n", "size", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // max(1, s + 2 * v) for n, s, v in rows]
