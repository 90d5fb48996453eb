from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from strandweave.llm import lm_score as S

from .helpers import documents, empty, frame


def brute(rows, order, alpha=S.ALPHA, least=S.LEAST):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    c = Counter(tuple(w[k : k + n]) for _, w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)
    out = []
    for i, w in words:
        logs, backed = 0.0, 0
        for k in range(len(w)):
            n, factor = min(order, k + 1), 1.0
            while n > 1 and c[tuple(w[k - n + 1 : k + 1])] < least:
                n, factor = n - 1, factor * alpha
            gram = tuple(w[k - n + 1 : k + 1])
            logs += math.log(factor * c[gram] / (c[gram[:-1]] if n > 1 else total))
            backed += factor < 1
        out.append((i, len(w), backed, logs / len(w) if w else None))
    return out


@pytest.mark.parametrize("order,chars", [(2, 1 << 20), (3, 700), (4, 5000)])
def test_matches_brute_force(spark, order, chars):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in documents()] + [(1000 + i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    df = frame(spark, [(*r, None, None, None) for r in rows])
    key = lambda r: (str(r[0]), r[1], r[2])
    got = sorted(((r.doc_id, r.n_words, r.n_backed_off, r.log_score) for r in S.score(df, order, batch_chars=chars, part_grams=1 << 12).collect()), key=key)
    want = sorted(brute(rows, order), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == w[3] or math.isclose(g[3], w[3], rel_tol=1e-9) for g, w in zip(got, want))


def test_empty(spark):
    assert S.score(empty(spark)).count() == 0
