from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandweave.llm import packing as P

from .helpers import documents, empty, frame


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    e = P.Encoder(cache_words=50)
    texts = [r[1] or "" for r in documents()] + ["  two  spaces ", " lead", "trail ", "a\n b\n\n c \n", "x <|endoftext|> y", "tab\t tab", "nbsp  é ß 日本", "don't we'll 12,34.5", "  x"]
    for t in texts:
        assert np.frombuffer(e.encode(t), e.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_batch_encodes_its_words_in_one_call(monkeypatch):
    """Texts of a batch together, known words or not, with white space at words' ends; each has its end after it."""
    e = P.Encoder(cache_words=20)
    calls = []
    new = e._new
    monkeypatch.setattr(e, "_new", lambda words: calls.append(len(words)) or new(words))
    for start in (0, 500):
        texts = [f"row {i} of word{i} and word{i + 1}" for i in range(start, start + 500)] + [None, "", " ", "a\n \nb", "x \n \n y ", "bar\n k", "\nfoo", "p \nfoo bar\n w", "two  spaces", "<|endoftext|> z", "e\x1c \x1cf", "日本 語 é"]
        ids, ends = e.encode_all(pa.array(texts), (P.END_ID,))
        want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids + [P.END_ID] for t in texts]
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want and ends[-1] == len(ids)
    assert sum(n > 1 for n in calls) == 2


@pytest.mark.parametrize("totals,segments", [([1000, 5000, 3, 0, 77], 3), ([1], 1), ([4096], 2), ([7] * 300, 5)])
def test_schedule_follows_the_mixture(totals, segments):
    totals = [t for t in totals if t]
    seen = np.zeros(len(totals), int)
    for p in range(segments):
        sizes, ends = P.schedule(totals, p, segments, 64)
        each = np.diff(np.vstack([np.zeros(len(totals), int), ends]), axis=0)
        assert (each >= 0).all() and (each.sum(1) == sizes).all()
        full = sizes == 64
        share = 64 * np.array(totals) / sum(totals)
        assert (np.abs(np.cumsum(each[full], 0) - np.outer(np.arange(1, full.sum() + 1), share)) < 2 + len(totals) / 64).all()
        assert all(s == 64 or s & (s - 1) == 0 for s in sizes.tolist())
        seen += ends[-1] if len(ends) else 0
    assert seen.tolist() == totals


def test_pieces_rebuild_every_document(spark):
    rows = documents()
    df = frame(spark, rows)
    got = P.pack(df, segment_tokens=3 * P.WINDOW).collect()
    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    ids = defaultdict(list)
    for doc, text, *_ in rows:
        ids[doc].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID], "<u4"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for doc, copies in ids.items():
        assert sum(r.length for r in pieces[doc]) == sum(map(len, copies))
        assert {r.start for r in pieces[doc]} >= {0}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == P.WINDOW or at & (at - 1) == 0


def test_sources_beyond_the_queues_share_them(spark):
    df = frame(spark)
    got = P.pack(df, max_queues=2)
    assert got.select("queue").distinct().count() <= 2
    assert got.agg({"length": "sum"}).first()[0] == P.pack(df).agg({"length": "sum"}).first()[0]
    assert P.pack(empty(spark)).count() == 0


def test_phases_keep_the_targets_until_a_queue_ends():
    got = P.phases([10_000, 10_000, 5_000, 0], [0.5, 0.25, 0.25, 0.0], 64)
    assert [sum(c) for c in zip(*got)] == [10_000, 10_000, 5_000, 0] and got[0] == (10_000, 5_000, 5_000, 0)
    assert P.phases([7, 5], [7, 5]) == [(7, 5)] and P.phases([], []) == []
    assert P.phases([100_000, 50_000], [1.0, 0.0]) == [(100_000, 0), (0, 50_000)]


@pytest.mark.parametrize("shares", [{"hot": 0.2, "s0": 0.5}, {"s2": 1.0}])
def test_windows_follow_given_proportions(spark, shares):
    rows = documents(n=200)
    df = frame(spark, rows)
    got = P.pack(df, window=64, segment_tokens=64 * 16, shares=shares).collect()
    assert sum(r.length for r in got) == P.pack(df).agg({"length": "sum"}).first()[0]
    sequences = defaultdict(lambda: defaultdict(int))
    for r in got:
        sequences[r.sequence_id][r.queue] += r.length
    full = [sequences[k] for k in sorted(sequences) if sum(sequences[k].values()) == 64]
    first = [w for w in full if all(w.get(f"={s}", 0) >= 1 for s in shares)][:10]
    assert len(first) == 10
    for source, share in shares.items():
        assert abs(sum(w[f"={source}"] for w in first) - 640 * share) <= 3
    with pytest.raises(ValueError):
        P.pack(df, shares={"a": 0.7, "b": 0.7})
