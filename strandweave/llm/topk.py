"""Exact top-k by inner product with a pivot-distance index.

Vectors are quantised to integers and lifted by one coordinate so that all
have the same norm M: then the distance of a lifted query (whose coordinate is
0) and a lifted vector falls as their inner product grows,
``d^2 = |q|^2 + M^2 - 2 q.v``, and an exact nearest-neighbour index serves an
inner-product search.

The index keys each vector by its nearest pivot and its distance from it.
Within a pivot, vectors sorted by distance form annuli (rings); a ring is a
range of distances, stored as blocks of at most ``BLOCK`` vectors. For a query
at distance D from the pivot, a vector in the ring [lo, hi] is no nearer than
``max(0, D - hi, lo - D)``, which bounds its score from above.

Search expands the rings in waves, nearest bound first: the first wave visits
the rings that hold at least k vectors with the best bounds, the next those
with a sixteenth of all vectors; each wave leaves a k-th best score, and a ring
whose bound can't reach it is never visited. Within a ring, blocks have ranges
of their own, which rule out queries again. The last wave visits exactly the
rings that the bound doesn't rule out, which makes the result exact.

Queries travel as blocks to the blocks of the rings they visit; no pair of a
query and a vector becomes a row. The number of pivots grows with the square
root of the number of vectors up to ``MOST_PIVOTS``; what is broadcast is
bounded: the pivots and the rings' ranges, at most ``MOST_PIVOTS * RINGS``.

How much is ruled out depends on the vectors: clustered ones leave most rings
unvisited (see the tests), independent ones of 64 dimensions none, as their
distances hardly differ.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, as queries or candidates; missing components of
shorter vectors count as 0; ties go to the smaller vec_id; a null vec_id takes
no part; with fewer candidates than k, all are returned; repeated vec_ids are
each a candidate, but never for a query of the same id; of a query's repeated
rows the least vector, by its components, asks; vectors so large that a score
may pass 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, saved, tune

PIVOTS, MOST_PIVOTS, RINGS = 32, 256, 32
#: Vectors that the pivots are picked from.
SAMPLE_ROWS = 4096
BLOCK, QUERY_BLOCK = 256, 128
#: Blocks of one ring that share a copy of the queries visiting it.
SHARE = 8
#: Bound of a float product's rounding, relative; bounds on scores are widened by it.
SLACK = 1e-9


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v array<long>``: floor(scale * x) of the vectors that take part."""
    ok = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity'))")
    return vectors.filter(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: by floats while those are exact, by integers otherwise."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if top < 2**53 else q @ v.T


def _lift(v: np.ndarray, norm2: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(norm2 - (f * f).sum(1, keepdims=True), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def pick_pivots(sample: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means, started from far-apart vectors."""
    rng = np.random.default_rng(seed)
    if len(sample) <= count:
        return sample
    centres = [sample[0]]
    near = _distances(sample, sample[:1])[:, 0]
    while len(centres) < count:
        total = (near**2).sum()
        k = int(rng.choice(len(sample), p=near**2 / total)) if total > 0 else len(centres)
        centres.append(sample[k])
        near = np.minimum(near, _distances(sample, sample[k : k + 1])[:, 0])
    out = np.array(centres)
    for _ in range(6):
        own = _distances(sample, out).argmin(1)
        for c in range(count):
            if (own == c).any():
                out[c] = sample[own == c].mean(0)
    return out


def _bounds(q: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm2: float) -> np.ndarray:
    """The highest score that the vectors between distances lo and hi from a pivot can give each query."""
    f = q.astype(np.float64)
    d = _distances(np.hstack([f, np.zeros((len(f), 1))]), pivots)[:, pivot]
    gap = np.maximum(0, np.maximum(d - hi, lo - d) - 1e-6 * (1 + d))
    square = (f * f).sum(1)[:, None]
    return (square + norm2 - gap * gap) / 2 + SLACK * (square + norm2) + 1


class Index:
    """Pivots and ring edges (on the driver), and the blocks of vectors (a table)."""

    def __init__(self, vectors: DataFrame, scale: int = 1024, pivots: int | None = None, rings: int = RINGS, sample_rows: int = SAMPLE_ROWS):
        self.spark = vectors.sparkSession
        tune(self.spark)
        # a vector's block takes many bytes; few blocks make a batch
        self.rows = saved(quantised(vectors, scale), "vectors")
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        top = self.rows.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm"), F.count(F.lit(1)).alias("n")).first()
        self.dim, self.norm2, self.n = int(top.dim or 0), float(top.norm or 0), int(top.n)
        self.empty = self.n == 0
        if self.empty:
            return
        if self.norm2 >= 2**62:
            raise OverflowError("scores of these vectors may pass 64 bits")
        pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, int(self.n**0.5 / 4)))
        sample = np.array([r.v + [0] * (self.dim - len(r.v)) for r in bounded_sample(self.rows, "vec_id", sample_rows).collect()], np.int64)
        lifted = _lift(sample, self.norm2)
        self.pivots = pick_pivots(lifted, pivots)
        d = _distances(lifted, self.pivots)
        own = d.argmin(1)
        self.edges = [np.unique(np.quantile(d[own == p, p], np.linspace(0, 1, rings + 1)[1:-1])) if (own == p).any() else np.zeros(0) for p in range(len(self.pivots))]
        self.blocks = saved(self._blocks(), "blocks")
        cells = self.blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
        self.cells = sorted(cells.collect())  # one for each ring at most
        number = np.array([c.cell for c in self.cells])
        self.pivot, self.lo, self.hi, self.count = number // RINGS, np.array([c.lo for c in self.cells]), np.array([c.hi for c in self.cells]), np.array([c.n for c in self.cells])

    def _blocks(self) -> DataFrame:
        """``cell, share, lo, hi, n, ids, vectors``; ids and vectors are packed integers."""
        dim, norm2, pivots, edges, rings = self.dim, self.norm2, self.pivots, self.edges, RINGS

        def keyed(batches):
            for batch in batches:
                v = _dense(batch.column(1), dim)
                d = _distances(_lift(v, norm2), pivots)
                own = d.argmin(1)
                far = d[np.arange(len(v)), own]
                ring = np.array([np.searchsorted(edges[p], x) for p, x in zip(own, far)], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own * rings + ring).astype(np.int32)), pa.array(far), batch.column(1)], ["vec_id", "cell", "far", "v"])

        def packed(batches):
            held: dict[int, list] = {}

            def block(cell: int):
                ids, far, v = zip(*held.pop(cell))
                return cell, float(min(far)), float(max(far)), len(ids), np.array(ids, np.int64).tobytes(), np.vstack(v).tobytes()

            def out(rows):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["cell", "lo", "hi", "n", "ids", "vectors"])

            for batch in batches:
                ready, v = [], _dense(batch.column(3), dim)
                for i, (vec, cell, far) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                    held.setdefault(cell, []).append((vec, far, v[i]))
                    if len(held[cell]) == BLOCK:
                        ready.append(block(cell))
                if ready:
                    yield out(ready)
            for cell in sorted(held):
                yield out([block(cell)])

        # rows of a ring stay together, and a large ring is dealt over partitions: ranges split by vec_id too
        sorted_ = self.rows.mapInArrow(keyed, "vec_id long, cell int, far double, v array<long>").repartitionByRange(F.col("cell"), F.col("far"), F.col("vec_id")).sortWithinPartitions("cell", "far", "vec_id")
        made = sorted_.mapInArrow(packed, "cell int, lo double, hi double, n long, ids binary, vectors binary")
        return made

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each ring can give each query."""
        return _bounds(q, self.pivots, self.pivot, self.lo, self.hi, self.norm2)

    def visited(self, q: np.ndarray, kth: np.ndarray) -> float:
        """The share of all (query, vector) pairs in rings whose bound reaches the query's k-th best score."""
        return float(((self.bounds(q) >= kth[:, None]) * self.count).sum() / (len(q) * self.n))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``query_id, rank, vec_id, score`` for the rows of ``queries(query_id, v)``."""
        cells, pivots, dim, norm2, shares = self.cells, self.pivots, self.dim, self.norm2, {c.cell: -(-c.blocks // SHARE) for c in self.cells}
        number, pivot, lo, hi, count = np.array([c.cell for c in cells]), self.pivot, self.lo, self.hi, self.count
        limits = [k, self.n // 16] if self.n > 64 * k else [k]

        def visits(q: np.ndarray, kth: np.ndarray, wave: int) -> np.ndarray:
            """Which rings each query visits: the next ones in the order of their bounds, as far as those reach the k-th score."""
            b = _bounds(q, pivots, pivot, lo, hi, norm2)
            order = np.argsort(-b, axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            due = np.ones_like(b, bool) if wave == len(limits) else before <= limits[wave]
            if wave:
                due &= before > limits[wave - 1]
            go = np.zeros_like(b, bool)
            np.put_along_axis(go, order, due, axis=1)
            return go & (b >= kth[:, None])

        def routed(wave: int):
            def run(batches):
                for batch in batches:
                    ids, q, kth = batch.column(0).to_numpy(), _dense(batch.column(1), dim), batch.column(2).to_numpy(zero_copy_only=False)
                    go = visits(q, kth, wave)
                    out = []
                    for c in np.flatnonzero(go.any(0)):
                        rows = np.flatnonzero(go[:, c])
                        for at in range(0, len(rows), QUERY_BLOCK):
                            some = rows[at : at + QUERY_BLOCK]
                            out += [(int(number[c]), s, ids[some].astype(np.int64).tobytes(), q[some].tobytes(), kth[some].tobytes()) for s in range(shares[int(number[c])])]
                            if len(out) >= 64:
                                yield pack_rows(out)
                                out = []
                    if out:
                        yield pack_rows(out)

            return run

        def pack_rows(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["cell", "share", "query_ids", "queries", "kths"])

        def best(batches):
            for batch in batches:
                rows: tuple[list, list, list] = ([], [], [])
                for qi, qv, kths, vi, vv, cell, low, high in zip(*(batch.column(c).to_pylist() for c in range(8))):
                    qids, vids = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                    q, v = np.frombuffer(qv, np.int64).reshape(-1, dim), np.frombuffer(vv, np.int64).reshape(-1, dim)
                    own = _bounds(q, pivots, np.array([cell // RINGS]), np.array([low]), np.array([high]), norm2)[:, 0] >= np.frombuffer(kths, np.float64)
                    if not own.any():
                        continue
                    qids, q = qids[own], q[own]
                    s = scores(q, v)
                    for i, query in enumerate(qids):
                        top = np.lexsort((vids, -s[i]))
                        top = top[vids[top] != query][:k]
                        rows[0].append(np.full(len(top), query))
                        rows[1].append(vids[top])
                        rows[2].append(s[i][top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in rows], ["query_id", "vec_id", "score"])

        # the number of a ring's block, dealt to its shares: each block meets each query block of its ring once
        dealt = self.blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("cell"))).cast("int"))

        def wave(of: DataFrame, number: int) -> DataFrame:
            met = of.mapInArrow(routed(number), "cell int, share int, query_ids binary, queries binary, kths binary").join(dealt, ["cell", "share"])
            return met.select("query_ids", "queries", "kths", "ids", "vectors", "cell", "lo", "hi").mapInArrow(best, "query_id long, vec_id long, score long")

        def top(found: DataFrame) -> DataFrame:
            """The k best of each query; partial lists are merged, never all candidates of a query at once."""
            key = F.struct((-F.col("score")).alias("a"), F.col("vec_id").alias("b"))
            salted = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list(key)), 1, k).alias("few"))
            lists = salted.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, k).alias("few"))
            return lists.select("query_id", F.posexplode("few").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.b").alias("vec_id"), (-F.col("x.a")).alias("score"))

        none = F.lit(float("-inf"))
        found = saved(wave(queries.select("query_id", "v", none.alias("kth")), 0), "wave")
        for number_ in range(1, len(limits) + 1):
            kth = top(found).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
            more = wave(queries.select("query_id", "v").join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", none).alias("kth")), number_)
            found = found.unionByName(more if number_ == len(limits) else saved(more, "wave"))
        return top(found)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The k best of all other vectors for each whose vec_id is divisible by ``every``."""
    index = Index(vectors, scale)
    if index.empty:
        return index.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = index.rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return index.search(queries, k)
