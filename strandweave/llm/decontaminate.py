"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts (questions and answers) are normalised to words: A-Z lower
case, ASCII other than letters and digits parts words. Each run of ``WORDS``
words of an item is a pattern; an item with fewer words is one pattern. One
automaton over the patterns, with one letter for each word, scans each
document's words once. Hits are word positions; they are mapped back to code
points of the original text for those documents that have any.

The automaton is built from a broadcast of the benchmark's words, counted as
they are cut: beyond ``MAX_WORDS`` the items, long ones in overlapping pieces
that have the same windows, are dealt into several automata, which scan one
after the other, with a written table between. A worker builds an automaton
once and keeps it for its other tasks.

Defined results: null or empty texts have no words and no hits; an item
without words has no pattern; equal items are counted each; items with a null
id count as one without a name; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, trimmed, tune

WORDS = 10
#: Words of the benchmark that one automaton holds, about; a word takes up to ten nodes of about 50 bytes.
MAX_WORDS = 500_000
#: Words of a piece of a long item.
PIECE_WORDS = 20_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def patterns(items: list[tuple[object, str | None]], n: int = WORDS) -> dict[tuple[bytes, ...], set[str | None]]:
    """Each window of n words, with the ids of the items that have it."""
    out: dict[tuple[bytes, ...], set[str | None]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, bool(w))):
            out.setdefault(tuple(w[i : i + n]), set()).add(None if item is None else str(item))
    return out


def pieces(benchmark: DataFrame, n: int = WORDS, size: int = PIECE_WORDS) -> DataFrame:
    """``item_id, text, words``: the items' normalised words; long items as pieces that overlap by n - 1 words."""
    cut = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD.pattern), 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)), F.lit(size))
    rows = benchmark.select("item_id", cut.alias("w")).filter(F.size("w") > 0)
    held = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size + n - 1))).alias("w"))
    return held.select(F.col("item_id").cast("string").alias("item_id"), F.array_join("w", " ").alias("text"), F.size("w").alias("words"))


def _letter(n: int) -> str:
    """The n-th character after the blank, past the surrogates: a word's letter in the automaton's alphabet."""
    return chr(n + 33 if n + 33 < 0xD800 else n + 33 + 0x800)


class Scanner:
    """The automaton, its letter for each word, and the items of each pattern."""

    def __init__(self, found: dict[tuple[bytes, ...], set[str | None]]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for pattern, items in found.items():
            key = "".join([self.letters.setdefault(w, _letter(len(self.letters))) for w in pattern])
            self.automaton.add_word(key, (len(key), items))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit ranges of word positions, and the items whose windows occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.letters or not text:
            return ranges, items
        get = self.letters.get
        for last, (length, ids) in self.automaton.iter("".join([get(w, " ") for w in text])):
            items |= ids
            a, b = last - length + 1, last + 1
            while ranges and ranges[-1][1] >= a:
                a, b = min(a, ranges[-1][0]), max(b, ranges.pop()[1])
            ranges.append((a, b))
        return ranges, items


FOUND = ("__n_words long", "__ranges array<int>", "__items array<string>", "__spans array<int>")

#: A worker's automaton, by its broadcast's name.
_kept: dict[str, Scanner] = {}


def _scanner(name: str, shared, n: int) -> Scanner:
    if name not in _kept:
        _kept.clear()
        _kept[name] = Scanner(patterns(shared.value, n))
    return _kept[name]


def scanned(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """``documents`` with the columns of ``FOUND``: the number of words; the hits as flat arrays of
    starts and ends, in words and in code points of the original text; and the items, sorted."""
    spark = documents.sparkSession
    tune(spark)
    sized = saved(pieces(benchmark, n, min(PIECE_WORDS, max(max_words, n))), "benchmark")
    total = sized.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = int(total // max_words) + 1
    columns = documents.columns
    kinds = dict(documents.dtypes)
    at_text = columns.index("text")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *FOUND])
    names = [*columns, *(f.split()[0] for f in FOUND)]
    out = documents.select("*", F.lit(0).cast("long").alias("__n_words"), *(F.array().cast(f.split()[1]).alias(f.split()[0]) for f in FOUND[1:]))
    for k in range(shards):
        own = sized.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in own])
        last = k == shards - 1

        def run(batches, shared=shared, last=last, name=uuid.uuid4().hex):
            scanner = _scanner(name, shared, n)
            for batch in batches:
                rows: list[list] = [[] for _ in range(4)]
                width = len(columns)
                for text, had, held in zip(*(batch.column(c).to_pylist() for c in (at_text, width + 1, width + 2))):
                    w = words(text)
                    found, items = scanner.scan(w)
                    if had:
                        found = merge([*zip(had[::2], had[1::2]), *found])
                    spans: list[int] = []
                    if last and found:
                        at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
                        spans = [x for a, b in found for x in (at[a][0], at[b - 1][1])]
                    for column, v in zip(rows, (len(w), [x for r in found for x in r], sorted({*items, *held}, key=lambda i: (i is None, i)), spans)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in range(width)), *(pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))))],
                    names,
                )

        out = out.mapInArrow(trimmed(run), schema)
        if not last:
            out = saved(out, "scanned")
            shared.unpersist()
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for every document."""
    ends, starts = F.filter("__ranges", lambda _, i: i % 2 == 1), F.filter("__ranges", lambda _, i: i % 2 == 0)
    total = [F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v) for x in (ends, starts)]
    return scanned(documents.select("doc_id", "text"), benchmark, n).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        (total[0] - total[1]).alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.size("__ranges") > 0).alias("contaminated"),
        F.col("__spans").alias("spans"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    return scanned(documents, benchmark, n).filter(F.size("__ranges") == 0).select(*documents.columns)
