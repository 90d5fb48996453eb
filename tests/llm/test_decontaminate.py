from __future__ import annotations

import hashlib
import re

import pytest

from strandweave.llm import decontaminate as D

from .helpers import COLUMNS, empty, frame, prose

ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven?"), (2, "short item here"), (3, None), (4, "..."), (5, "Über straße nine ten"), (10, "short, item: here"), (None, "null id words"), (11, "null ID, words")]
TEXTS = ["x one two three four five six seven eight nine ten eleven y", "One, two; three four five six seven eight nine ten!", "one two three four five six seven eight nine", "short item here short item here", "ÜBER Über straße nine ten", None, "", "a short item herex", "null ID words", "Ünull id words"]


def by_definition(text):
    w = [m.group() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    hit, items = set(), set()
    for item, t in ITEMS:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(10, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    items.add(item if item is None else str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(i for i in items if i)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [D.MAX_WORDS, 8])
def test_matches_the_definition(spark, most):
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(TEXTS)])
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = {r.doc_id: r for r in D.scanned(df, bench, max_words=most).collect()}
    for r in D.contamination(df, bench).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == by_definition(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert sum(b - a for a, b in zip(found[r.doc_id]["__ranges"][::2], found[r.doc_id]["__ranges"][1::2])) == r.n_hit
    assert TEXTS[1][slice(*found[1]["__spans"])] == TEXTS[1][:-1]
    assert TEXTS[4][slice(*found[4]["__spans"])] == "Über straße nine ten"


def test_clean_keeps_the_rest(spark):
    import random

    df = frame(spark)
    bench = spark.createDataFrame([(1, prose(random.Random(9), 30))], "item_id bigint, text string")
    assert D.clean(df, bench).count() == df.count() and D.clean(df, bench).columns == df.columns
    assert D.clean(df, bench.limit(0)).count() == df.count() and D.contamination(empty(spark), bench).count() == 0
    leaky = spark.createDataFrame([(900, "see " + bench.first().text + " end", "en", "s", 1)], COLUMNS)
    assert D.clean(leaky, bench).count() == 0


def test_words_are_counted_as_they_are_cut_and_long_items_are_parted(spark):
    import random

    rng = random.Random(3)
    long = [f"w{rng.randint(0, 99999)}" for _ in range(500)]
    bench = spark.createDataFrame([(1, ",".join(long)), (2, "tiny"), (3, None)], "item_id bigint, text string")
    assert sum(r.words for r in D.pieces(bench).collect()) == 501
    cut = D.pieces(bench, size=40).collect()
    assert max(r.words for r in cut) <= 49 and set(D.patterns([(r.item_id, r.text) for r in cut])) == set(D.patterns([(1, ",".join(long)), (2, "tiny")]))
    texts = [" ".join(long[k : k + 12]) for k in range(0, 480, 37)] + ["tiny thing", " ".join(long[:9])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for most in (20, 10**6):
        assert [D.scanned(df, bench, max_words=most).filter("size(__ranges) > 0").count()] == [len(texts) - 1]


def test_spans_point_at_the_words_of_the_original(spark):
    df = frame(spark, [(i, t, None, None, None) for i, t in enumerate(TEXTS)])
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for r in D.contamination(df, bench).collect():
        held = [w for a, b in zip(r.spans[::2], r.spans[1::2]) for w in D.words(TEXTS[r.doc_id][a:b])]
        assert len(held) == r.n_hit
