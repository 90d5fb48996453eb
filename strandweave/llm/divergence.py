"""Divergence of sources: how the words of each source of a language differ from those of the others.

Each group (lang, source), and each language, has a smoothed share p of every
kept term in whole billionths; two groups differ by the sum of
``floor((p - q)^2 / (p + q))`` over the language's kept terms. All arithmetic is
on whole numbers.

A term that a group lacks has the group's base share there. So the sum over a
language's V terms is V times the difference of the two bases, plus corrections
of the terms that at least one of them has. These are split:

* Heavy terms, in more than ``LIGHT`` groups of the language, go into dense
  tiles: ``TILE_TERMS`` terms by two blocks of ``BLOCK`` groups, numpy matrices
  of shares, with the base where the term is absent.
* Of light terms, each group's shares are corrected against the other's base
  (the terms enter as a histogram of shares), and the few pairs of groups that
  have a term both are corrected from the posting lists, none of which is longer
  than ``LIGHT``.

Partial sums are added by pair. Words are counted where texts are read, ``FLUSH``
entries at a time, so one row for each group and term leaves a task; a group or
language with most of the rows is spread by term, and by tile.

Defined results: null texts, langs and sources count as ''; a text without terms
gives none but its group exists; equal rows count each; a language without kept
terms has pairs of value 0 and no terms; an empty table has no rows; terms of any
length and long texts are taken whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, tune

#: Documents of a language that a term is at least in.
LEAST_DOCS = 10
#: Groups up to which a term's pairs come from its posting list.
LIGHT = 8
#: Terms, and groups to a side, of a dense tile.
TILE_TERMS, BLOCK = 4096, 64
#: Rows of the histograms of light terms' shares for a tile, about.
TILE_SHARES = 1 << 20
#: Terms of a group that are listed.
TOP = 10
#: Counts that a task holds before it sends them.
FLUSH = 400_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

#: Bytes of terms, A-Z lowered, all others blank.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: str | None):
    """The text's terms, a list for each piece of it; no term is cut."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: how often a group has a term and in how many documents; a null term for each group."""

    def count(batches):
        total: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)
        held = 0

        def send():
            for (lang, source), found in total.items():
                names = list(found)
                for a in range(0, len(names), 1 << 16):
                    some = names[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([found[t] for t in some], pa.int64()), pa.array([docs[lang, source][t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])

        groups: set[tuple] = set()
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own, seen = total[lang, source], set()
                groups.add((lang, source))
                held -= len(own)
                for words in pieces(text):
                    own.update(words)
                    seen.update(words)
                docs[lang, source].update(seen)
                held += len(own)
                if held >= FLUSH:
                    yield from send()
                    total.clear()
                    docs.clear()
                    held = 0
        yield from send()
        langs, sources = zip(*groups) if groups else ((), ())
        zeros = pa.array([0] * len(langs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.nulls(len(langs), pa.string()), zeros, zeros], ["lang", "source", "term", "n", "docs"])

    tune(documents.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sent = documents.select(text("lang"), text("source"), text("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, of: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (of + 2 * terms)), by long division in thousands, so that nothing overflows."""
    m = f"greatest({of} + 2 * {terms}, 1)"
    out, left = f"1 + (({n} + 2) div {m}) * 1000000000", f"(({n} + 2) % {m})"
    for unit in (1_000_000, 1_000, 1):
        out, left = f"{out} + (({left} * 1000) div {m}) * {unit}", f"(({left} * 1000) % {m})"
    return F.expr(out)


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


#: Kinds of a tile's rows: a group with its base and, in one tile, the number of terms; a heavy term, a share with the number of a group's light terms that have it.
_BASE, _TERM, _SHARE = 0, 1, 2


def tile_sums(table: pa.Table, width: int) -> pa.Table:
    """``lang, g, h, value``: what one tile adds to each pair g < h of groups of its two blocks of ``width`` groups."""
    lang, gi, gj = (table.column(c)[0].as_py() for c in ("lang", "gi", "gj"))
    kind, number, p, times = (table.column(c).to_numpy() for c in ("kind", "number", "p", "times"))
    block = number // width
    sides = []
    for side in (gi, gj):
        at = np.flatnonzero((kind == _BASE) & (block == side))
        at = at[np.argsort(number[at])]
        sides.append((side, number[at], p[at], times[at]))
    (_, a, base_a, terms), (_, b, base_b, _) = sides
    out = np.zeros((len(a), len(b)), np.int64)
    bases = _f(base_a[:, None], base_b[None, :])
    out += terms[:, None] * bases
    heavy = np.flatnonzero(kind == _TERM)
    if len(heavy):
        term = np.unique(table.column("term").combine_chunks().dictionary_encode().indices.take(pa.array(heavy)).to_numpy(), return_inverse=True)[1]
        full = []
        for side, numbers, base, _ in sides:
            m = np.repeat(base[None, :], term.max() + 1, axis=0)
            own = block[heavy] == side
            m[term[own], np.searchsorted(numbers, number[heavy][own])] = p[heavy][own]
            full.append(m)
        for k in range(len(a)):
            out[k] += _f(full[0][:, k, None], full[1]).sum(axis=0) - len(full[0]) * bases[k]
    for flip, (side, numbers, _, _) in enumerate(sides):
        rows = np.flatnonzero((kind == _SHARE) & (block == side))
        rows = rows[np.argsort(number[rows], kind="stable")]
        cut = np.searchsorted(number[rows], [numbers, numbers + 1])
        others = base_a if flip else base_b
        for k, (x, z) in enumerate(cut.T.tolist()):
            for y in range(x, z, 1 << 14):
                some = rows[y : min(z, y + (1 << 14))]
                own = bases[:, k] if flip else bases[k]
                more = (times[some, None] * (_f(p[some, None], others[None, :]) - own[None, :])).sum(axis=0)
                if flip:
                    out[:, k] += more
                else:
                    out[k] += more
    g, h = np.nonzero(a[:, None] < b[None, :])
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(a[g]), "h": pa.array(b[h]), "value": pa.array(out[g, h])})


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, value`` for every two groups g < h of a language."""
    light, heavy = cells.filter(F.col("d") <= LIGHT), cells.filter(F.col("d") > LIGHT)
    shares = saved(light.groupBy("lang", "number", "p").agg(F.count(F.lit(1)).alias("times")), "shares")
    sizes = shares.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SHARES).alias("share_tiles"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.ceil((F.max("v") - F.max("v_light")) / TILE_TERMS).alias("term_tiles"))
    shape = F.broadcast(saved(blocks.join(sizes, "lang", "left").withColumn("share_tiles", F.greatest(F.coalesce("share_tiles", F.lit(1)), F.lit(1))), "shape"))  # a row for each language
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["lang", "tile", "blocks", "kind", "number", "term", "p", "times"]
    of_terms = heavy.join(shape, "lang").select("lang", F.pmod(F.xxhash64("term"), "term_tiles").alias("tile"), "blocks", F.lit(_TERM).alias("kind"), "number", "term", "p", F.lit(0).cast("long").alias("times"))
    of_shares = shares.join(shape, "lang").select("lang", (-1 - F.pmod(F.xxhash64("p"), "share_tiles")).alias("tile"), "blocks", F.lit(_SHARE).alias("kind"), "number", none("string").alias("term"), "p", "times")
    tiles = F.explode(F.sequence(-F.col("share_tiles"), F.col("term_tiles") - 1))
    of_groups = groups.join(shape, "lang").withColumn("tile", tiles).select("lang", "tile", "blocks", F.lit(_BASE).alias("kind"), "number", none("string").alias("term"), F.col("base").alias("p"), F.when(F.col("tile") == -1, F.col("v")).otherwise(F.lit(0)).alias("times"))
    rows = of_terms.unionByName(of_shares).unionByName(of_groups).select(*columns)
    own = F.floor(F.col("number") / BLOCK).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("gi", F.least(own, "other")).withColumn("gj", F.greatest(own, "other"))
    width = BLOCK
    dense = rows.select("lang", "tile", "gi", "gj", "kind", "number", "term", "p", "times").groupBy("lang", "tile", "gi", "gj").applyInArrow(lambda table: tile_sums(table, width), "lang string, g long, h long, value long")
    lists = light.filter("d > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "base")).alias("l"))
    both = lambda x: F.transform(F.filter("l", lambda y: y["number"] > x["number"]), lambda y: F.struct(x.alias("x"), y.alias("y")))
    met = lists.select("lang", F.explode(F.flatten(F.transform("l", both))).alias("z")).select("lang", "z.x", "z.y")
    part = lambda x, y: differ(F.col(x), F.col(y))
    sparse = met.select("lang", F.col("x.number").alias("g"), F.col("y.number").alias("h"), (part("x.p", "y.p") - part("x.p", "y.base") - part("x.base", "y.p") + part("x.base", "y.base")).alias("value"))
    return dense.unionByName(sparse).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language the other ones by how much they differ
    (``part`` 'pair'), and the ``top`` terms that it has more of than its language ('term')."""
    found = saved(counts(documents), "counts")
    by_term = Window.partitionBy("lang", "term")
    kept = found.filter("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("in_docs"), F.sum("n").over(by_term).alias("total"), F.count(F.lit(1)).over(by_term).alias("d"))
    kept = saved(kept.filter(F.col("in_docs") >= least_docs).drop("in_docs"), "kept")
    langs = kept.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("d") <= LIGHT, 1)).alias("v_light"), F.sum("total").alias("lang_size"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = lambda *names: {c: F.coalesce(c, F.lit(0)) for c in names}
    groups = found.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero("size", "v", "v_light", "lang_size"))
    numbers = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = saved(groups.withColumn("number", numbers).withColumn("base", share("0", "size", "v")), "groups")
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "size", "v"))
    cells = saved(cells.select("lang", "source", "term", "number", "d", "p", "base", share("total", "lang_size", "v").alias("q")), "cells")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    terms = ranked(terms).filter(F.col("rank") <= top)
    sides = F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"))))
    named = lambda number, name: groups.select("lang", F.col("number").alias(number), F.col("source").alias(name))
    pairs = _pairs(cells, groups).select("lang", "value", sides.alias("s")).select("lang", "value", "s.g", "s.h").join(named("g", "source"), ["lang", "g"]).join(named("h", "item"), ["lang", "h"])
    return ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")).unionByName(terms)


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same result in DuckDB SQL, every pair of groups by every kept term."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce(s.n, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT) // (g.size + 2 * v.v) AS BIGINT) AS p, 1 + CAST(1000000000 * CAST(k.n + 2 AS HUGEINT) // (v.n + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {top}"""
