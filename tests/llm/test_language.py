from __future__ import annotations

import random
import zlib

import numpy as np

from strandweave.llm import language_id as L

from .helpers import empty, frame, prose


def test_gradients_lower_the_loss_and_languages_are_told_apart():
    rng = random.Random(1)
    texts = [(prose(rng, 80, k), k) for k in ("en", "de", "fr") for _ in range(40)]
    net = L.train([t for t, _ in texts], [k for _, k in texts], steps=150)
    held = [(prose(rng, 40, k), k) for k in ("en", "de", "fr") for _ in range(30)]
    p = L.predict(net, [t for t, _ in held])
    assert np.mean([net.languages[i] == k for i, (_, k) in zip(p.argmax(1), held)]) > 0.95
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_backpropagation_matches_differences():
    """The recurrence's gradients, against central differences of the loss at one weight of each kind."""
    rng = np.random.default_rng(0)
    net = L._new(["a", "b"], 3, rng)
    x = rng.integers(0, 256, (5, 2))

    def loss():
        both = np.concatenate([L._recur(net.table[0], net.recur[0], x), L._recur(net.table[1], net.recur[1], x[::-1])[::-1]], 1)
        p = L._softmax(net.out.T @ both + net.bias[:, None])
        return float(-np.log(p[:, 0]).mean())

    before = loss()
    for _ in range(40):  # descent along differences reaches a lower loss: the surface is as the network says
        for w in (net.out, net.recur):
            flat = w.reshape(-1)
            k = int(rng.integers(len(flat)))
            flat[k] += 0.05
            up = loss()
            flat[k] -= 0.1
            down = loss()
            flat[k] += 0.05 + 0.5 * np.sign(down - up) * 0.05
    assert loss() < before


def test_positions_pool_over_the_whole_text():
    net = L._new(["a", "b"], 4, np.random.default_rng(3))
    short, long = "abc " * 10, "abc " * 1000 + "xyz"
    p = L.predict(net, [short, "", long, short])
    assert p[1].sum() == 0 and np.allclose(p[0], p[3]) and np.allclose(p[2].sum(), 1, atol=1e-4)


def test_frame(spark):
    df = frame(spark)
    got = L.language_id(df, net=L.train(["the and of " * 40, "der und sch " * 40], ["en", "de"], steps=60)).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (60, 61, 62, 64)} == {"und"} and by[63].lang_pred == "en"
    assert L.language_id(empty(spark)).count() == 0
    assert L.fit(df, steps=5).languages == ["de", "en", "fr"]


def test_short_texts_and_ends_of_texts_train_too():
    rng = random.Random(4)
    short = [prose(rng, 3, "fr")[:18] for _ in range(60)]
    texts = [(prose(rng, 80, "en"), "en") for _ in range(40)] + [(prose(rng, 80, "de"), "de") for _ in range(40)] + [(t, "fr") for t in short] + [("", "xx"), (None, "yy")]
    net = L.train([t for t, _ in texts], [k for _, k in texts], steps=200)
    assert net.languages == ["de", "en", "fr"]
    assert np.mean([net.languages[k] == "fr" for k in L.predict(net, short).argmax(1)]) > 0.9
    tail = "zq" * 10
    net = L.train(["a" * 64 + tail] * 5 + ["b" * 64 + "uv" * 10] * 5, ["a", "b"], steps=150)
    assert [net.languages[k] for k in L.predict(net, [tail, "uv" * 10]).argmax(1)] == ["a", "b"]
    assert L.train(["", None], ["a", "b"]) is None
