from __future__ import annotations

import re

import duckdb
import pytest

from strandweave.llm import licenses as L

from .helpers import empty, frame, prose


def by_definition(text):
    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = shingles(text or "")
    return {(k, len(s & own)) for k, v in L.TEMPLATES.items() if len((s := shingles(v)) & own) >= 0.8 * len(s)}


def test_finds_every_template_anywhere(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i, (name, t) in enumerate(sorted(L.TEMPLATES.items())):
        for shift in range(5):
            rows.append((10 * i + shift, prose(rng, 7 + shift) + " " + t.upper() + "\n" + prose(rng, shift), None, None, None))
        rows.append((10 * i + 9, t.replace(" ", "  -- "), None, None, None))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "licensed under the", None, None, None), (903, prose(rng, 5000) + " Released under the MIT License.", None, None, None)]
    df = frame(spark, rows)
    got = {}
    for r in L.scan(df).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.n_shared))
    assert got == {r[0]: d for r in rows if (d := by_definition(r[1]))}
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    assert sorted(con.sql(L.oracle()).fetchall()) == sorted(tuple(r) for r in L.scan(df).collect())


def test_awkward_rows(spark):
    assert L.scan(empty(spark)).count() == 0 and L.scan(frame(spark)).count() == 0
    with pytest.raises(ValueError):
        L.scan(frame(spark), {"x": "only four words here"})


def test_templates_of_any_number_and_length(spark):
    import random

    rng = random.Random(5)
    words = lambda n: " ".join(f"{prose(rng, 1)}{rng.randint(0, 999)}" for _ in range(n))
    templates = {f"t{k}": words(rng.randint(5, 40)) for k in range(1200)} | {"long": words(5000), "one": "just one shingle of words"}
    whole = templates["long"].split()
    rows = [(k, f"{words(rng.randint(0, 30))} {templates[f't{k}']} {words(rng.randint(0, 30))}") for k in range(0, 1200, 3)]
    rows += [(5000, templates["long"]), (5001, " ".join(whole[:4200])), (5002, " ".join(whole[:3000])), (5003, words(9) + " just one shingle of words " + words(7))]
    got = {(r.doc_id, r.license) for r in L.scan(frame(spark, [(*r, None, None, None) for r in rows]), templates).collect()}
    assert got == {(k, f"t{k}") for k in range(0, 1200, 3)} | {(5000, "long"), (5001, "long"), (5003, "one")}


def test_bands_bound_the_misses():
    for t in range(1, 30):
        b = L.bands_for(t)
        held = min(t, L.WINDOW - 1) / L.WINDOW
        assert (1 - held) ** b <= L.MISSED and (b == 1 or (1 - held) ** (b - 1) > L.MISSED)
