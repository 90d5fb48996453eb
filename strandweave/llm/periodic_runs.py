"""Periodic runs of words, by matching aligned power-of-two blocks.

A run is a stretch of words that repeats with smallest period q, at least
``max(LEAST, TIMES * q)`` words long, that no neighbouring word extends. Periods
are sought by scale: at scale B, a power of two, those from B to 2B - 1. The
blocks of B words that start at multiples of B are the keys of an Aho-Corasick
automaton over word numbers, and the automaton reads the text. A run of such a
period holds an aligned block that occurs again one period on, so a block found
d words behind its own aligned place, B <= d < 2B, is a seed: it is extended
exactly in both directions while words d apart are the same. For each place of
an occurrence there is just one aligned place that far back, so there are at
most n seeds a scale, and seeds inside a known run whose period divides theirs
are no news.

Only stretches that can hold a run of the scale are read: in a run, every word
after the first q has the same word at most q places before it.

Words are numbered by a dictionary for each text, so nothing rests on hashes.
Every row is answered by itself, in one pass and without a shuffle.

Defined results: null and empty texts, and texts of white space, have no word,
no run, and the digests of the empty text; a null doc_id is never rewritten by
``planted``; equal rows are answered each; a text is held whole by its task.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tune

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
#: Words of texts whose places are compared at a time, about.
CHUNK_WORDS = 1 << 20


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in each tenth document, by the checksum of its id: from a place on, a period of the
    original words repeats."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * -(-(n - a) // p))[: n - a]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as numbers, one text after the other, no number in two texts; and where each text starts."""
    out: list[int] = []
    starts = [0]
    first = 0
    for words in texts:
        known: dict[bytes, int] = {}
        out += [known.setdefault(w, first + len(known)) for w in words]
        first += len(known)
        starts.append(len(out))
    return np.array(out, np.int64), np.array(starts, np.int64)


def back(ids: np.ndarray) -> np.ndarray:
    """How many places before each word the same one stands; a huge number if nowhere."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), np.iinfo(np.int64).max)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = np.diff(order)[same]
    return out


def stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of true flags of at least ``least``, as half-open ranges."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    a, b = edges[::2], edges[1::2]
    long_ = b - a >= least
    return list(zip(a[long_].tolist(), b[long_].tolist()))


def seeds(ids: np.ndarray, start: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks that occur again, and how far on, for words that start at place ``start`` of their text."""
    word = ids.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    numbers: dict[tuple, int] = {}
    at: dict[int, int] = {}
    for i in range(-start % block, len(word) - block + 1, block):
        key = tuple(word[i : i + block])
        at[i] = numbers.setdefault(key, len(numbers))
    for key, number in numbers.items():
        automaton.add_word(key, number)
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton.make_automaton()
    found = []
    for last, number in automaton.iter(tuple(word)):
        j = last - block + 1
        i = j - block - (j + start) % block  # the one aligned place from B to 2B - 1 words before
        if at.get(i) == number:
            found.append((i, j - i))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _same_from(ids: np.ndarray, a: int, b: int, stop: int, step: int) -> int:
    """For how many places from ``a`` and ``b`` on, in direction ``step``, words are the same; ``stop`` at most."""
    done, size = 0, 16
    while done < stop:
        size = min(size, stop - done)
        x = ids[a + done : a + done + size] if step > 0 else ids[a - done - size + 1 : a - done + 1][::-1]
        y = ids[b + done : b + done + size] if step > 0 else ids[b - done - size + 1 : b - done + 1][::-1]
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, size = done + size, size * 2
    return done


def runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not any(texts):
        return out
    ids, starts = numbered(texts)
    before = back(ids)
    held: list[set[tuple[int, int]]] = [set() for _ in texts]
    block, longest = 1, int(np.diff(starts).max())
    while max(LEAST, TIMES * block) <= longest:
        # in a run of a period of this scale, at least so many words come after its first period
        least = min(max(LEAST, TIMES * q) - q for q in range(block, min(2 * block, block + LEAST)))
        known, ends, listed = {}, {}, {}  # runs of smaller periods, for each text
        pieces = []
        for a, b in stretches(before < 2 * block, least):
            k = int(np.searchsorted(starts, a, "right")) - 1
            if k not in known:
                known[k] = np.array(sorted(r for r in out[k] if r[1] >= 2 * block and r[2] < block), np.int64).reshape(-1, 3)
                ends[k], listed[k] = known[k][:, 0] + known[k][:, 1], known[k].tolist()
            # a run of this scale shares fewer than three blocks with one of a smaller period: it lies before or behind a long one
            for at in range(int(np.searchsorted(ends[k], a - starts[k], "right")), len(listed[k])):
                s, n, q = listed[k][at]
                s += int(starts[k])
                if s >= b:
                    break
                if n >= 3 * block:
                    pieces.append((k, a, min(b, s + 3 * block)))
                    a = max(a, s + n - q)
            pieces.append((k, a, b))
        for k, a, b in pieces:
            if b - a < least:
                continue
            low = max(int(starts[k]), a - 2 * block + 1)
            part, offset = ids[low:b], low - int(starts[k])
            i, d = seeds(part, offset, block)
            if len(known[k]) and len(i):
                # two runs of smaller periods share fewer than two blocks, so only the last that starts before a seed may hold it
                s, _, q = known[k].T
                at = np.searchsorted(s, i + offset, "right") - 1
                new = (at < 0) | (i + offset + d + block > ends[k][at]) | (d % q[at] > 0)
                i, d = i[new], d[new]
            order = np.lexsort((i, d))
            period, end = 0, -1
            for x, q in zip(i[order].tolist(), d[order].tolist()):
                if q == period and x + q < end:
                    continue
                left = _same_from(part, x - 1, x + q - 1, x, -1)
                right = _same_from(part, x + block, x + q + block, len(part) - x - q - block, 1)
                first, period, end = x - left, q, x + q + block + right
                run = (offset + first, end - first, q)
                if run[1] >= max(LEAST, TIMES * q) and run[:2] not in held[k]:
                    held[k].add(run[:2])
                    out[k].append(run)
        block *= 2
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = (*[pa.int64()] * 5, pa.string(), pa.string())


def _answer(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    spelled = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(found), *best, milli, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest()


def find(documents: DataFrame, rewrite=planted) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` for every document; ``rewrite``
    makes the words to search of a text's words and its doc_id (None: the text's own)."""
    kind = dict(documents.dtypes)["doc_id"]

    def search(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            held: list[list[bytes]] = []
            size = 0
            for k, (doc_id, text) in enumerate(zip(ids, texts)):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                held.append(rewrite(words, doc_id) if rewrite else words)
                size += len(words)
                if size >= CHUNK_WORDS or k == len(ids) - 1:
                    rows += [_answer(w, r) for w, r in zip(held, runs(held))]
                    held, size = [], 0
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    tune(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, {SCHEMA}")


def dropped_runs(documents: DataFrame) -> DataFrame:
    """``documents`` with each run in a text cut to its first period; a text with a run has its words joined by blanks, any
    other stays as it is, null too. ``n_chars``, if there is one, follows a new text."""
    columns, kinds = documents.columns, dict(documents.dtypes)

    def cut(batches):
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            new = [collapsed(w, r).decode("utf-8", "surrogatepass") if r else t for t, w, r in zip(texts, words, runs(words))]
            values = dict(zip(columns, batch.columns)) | {"text": pa.array(new, pa.string())}
            if "n_chars" in values:
                values["n_chars"] = pa.array([o if n is t else len(n) for o, n, t in zip(values["n_chars"].to_pylist(), new, texts)], values["n_chars"].type)
            yield pa.RecordBatch.from_arrays([values[c] for c in columns], columns)

    tune(documents.sparkSession)
    return documents.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
