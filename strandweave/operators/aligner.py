"""Alignment of sequences to references: minimizers, seeds, chains along diagonals, extension.

Every ``span`` words of ``word`` bases that follow one another give the one of
least rank, a minimizer; a word and its reverse complement are one. Minimizers of
queries and references meet in an equi-join. Words that the references have very
often are left out there, but each stretch of a query keeps its few rarest. Seeds of a
query, a reference and a strand are cut into chains where the diagonal, or the
place on the reference, leaves a gap. Only then are bases fetched, for the chains
alone: between the first and the last seed they are compared as wholes, and ends
are added while they are alike enough. Sequences are rows of pieces throughout, so
neither a long reference nor a long query is copied for each chain.

Results have the shape of alignment records. Null and empty sequences have no
words: a query without chains is one unmapped record. Words with other letters
than A, C, G and T seed nothing. Names of queries and of references are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alignment import distance_of
from ..functions.strand import rc_sequence
from ..plans.tables import written
from .intervals import contig_lengths, filtered, merge, oriented, wide_enough

#: Bases of a word (odd, at most 15) and words of which one is taken.
WORD, SPAN = 15, 10
#: Bases of a row of a sequence.
PIECE = 1 << 14
#: Places on references up to which every word seeds; bases of a stretch, and its rarest words that seed however often they are.
OFTEN, STRETCH, RAREST = 200, 500, 5
#: Gaps on the diagonal, and on the reference, that end a chain; seeds of a chain.
DRIFT, GAP, LEAST_SEEDS = 200, 5000, 3
#: Highest share of edits in what is added to a chain's ends; the least bases that are added.
ERRORS, LEAST_END = 0.2, 1
# The multiplier and the prime of a bijection of words' numbers that ranks them. A word of 15 bases is below the prime.
_MULTIPLIER, _PRIME = 2654435761, 4294967291


def pieces(sequences: DataFrame, size: int = PIECE, more: int = 0) -> DataFrame:
    """``name, no, s``: each sequence in rows of ``size`` bases, and the ``more`` bases after them."""
    n = F.length("sequence")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.struct(i.alias("no"), F.substr("sequence", i * size + 1, F.lit(size + more)).alias("s")))
    return sequences.filter(n > 0).select("name", F.explode(cut).alias("p")).select("name", "p.no", "p.s")


def rank(word: Column) -> Column:
    """The rank of a word of A, C, G and T, another one for each; null with other letters."""
    number = F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("bigint")
    return F.when(F.translate(word, "ACGT", "") == "", (number * _MULTIPLIER) % _PRIME)


def minimizers(sequences: DataFrame, word: int = WORD, span: int = SPAN, size: int = PIECE) -> DataFrame:
    """``name, key, pos, forward``: the word of least rank of each ``span`` words in a row, the first of equal ones, once;
    of all words where a sequence has fewer. ``forward`` says whether the word is the lesser one of the two strands."""
    if not 0 < word <= 15 or word % 2 == 0:
        raise ValueError("words have an odd number of bases up to 15")
    held = pieces(sequences, size, word + span - 2)

    def one(i: Column) -> Column:
        w = F.substr("s", i + 1, F.lit(word))
        back = rc_sequence(w)
        r = rank(F.least(w, back))
        return F.when(r.isNotNull(), F.struct(r.alias("key"), i.alias("at"), (w <= back).alias("forward")))

    words = held.filter(F.length("s") >= word).select("name", "no", F.transform(F.sequence(F.lit(0), F.length("s") - word), one).alias("w"))
    words = words.filter((F.col("no") == 0) | (F.size("w") >= span))  # a sequence's last rows may have no whole window
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - span, F.lit(0)))
    least = F.array_distinct(F.array_compact(F.transform(starts, lambda i: F.array_min(F.slice("w", i + 1, span)))))
    # a window that starts in a piece may have its word among the bases after it: the next piece can have that word too
    return words.select("name", "no", F.explode(least).alias("m")).select("name", F.col("m.key").alias("key"), (F.col("no") * size + F.col("m.at")).alias("pos"), F.col("m.forward").alias("forward")).distinct()


def seeds(queries: DataFrame, references: DataFrame, word: int = WORD, span: int = SPAN, often: int = OFTEN, stretch: int = STRETCH) -> DataFrame:
    """``query, ref, same, qpos, rpos``: places where a minimizer of a query, and of a reference, are the same; ``qpos`` is that
    on the query's other strand unless ``same``."""
    sizes = queries.select(F.col("name").alias("query"), F.length("sequence").alias("n"))
    of = minimizers(references, word, span).select("key", F.col("name").alias("ref"), F.col("pos").alias("rpos"), F.col("forward").alias("ref_forward"))
    of = written(of, "minimizers")
    counts = of.groupBy("key").agg(F.count(F.lit(1)).alias("places"))
    own = minimizers(queries, word, span).join(counts, "key").withColumnRenamed("name", "query")
    nth = F.row_number().over(Window.partitionBy("query", F.floor(F.col("pos") / stretch)).orderBy("places", "pos"))
    used = own.withColumn("nth", nth).filter((F.col("places") <= often) | (F.col("nth") <= RAREST))
    met = used.join(of, "key").join(sizes, "query")
    same = F.col("forward") == F.col("ref_forward")
    return met.select("query", "ref", same.alias("same"), F.when(same, F.col("pos")).otherwise(F.col("n") - word - F.col("pos")).alias("qpos"), "rpos")


def chains(found: DataFrame, drift: int = DRIFT, gap: int = GAP, least: int = LEAST_SEEDS) -> DataFrame:
    """``query, ref, same, q_from, q_to, r_from, r_to, n``: first and last places of seeds that lie along a diagonal."""
    one = ["query", "ref", "same"]
    by = Window.partitionBy(*one).orderBy("diagonal", "rpos")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > drift
    laned = found.withColumn("diagonal", F.col("rpos") - F.col("qpos")).withColumn("cut", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("lane", F.sum("cut").over(by))
    along = Window.partitionBy(*one, "lane").orderBy("rpos", "qpos")
    far = F.col("rpos") - F.lag("rpos").over(along) > gap
    parted = laned.withColumn("cut", F.coalesce(far, F.lit(False)).cast("int")).withColumn("part", F.sum("cut").over(along))
    first, last = F.min(F.struct("rpos", "qpos")), F.max(F.struct("rpos", "qpos"))
    out = parted.groupBy(*one, "lane", "part").agg(first.alias("a"), last.alias("z"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least).filter("z.qpos >= a.qpos").select(*one, F.col("a.qpos").alias("q_from"), F.col("z.qpos").alias("q_to"), F.col("a.rpos").alias("r_from"), F.col("z.rpos").alias("r_to"), "n")


def fetched(ranges: DataFrame, held: DataFrame, size: int = PIECE) -> DataFrame:
    """``id, bases``: the bases from ``a`` up to ``z`` of ``name`` for ``ranges(id, name, a, z)``, from the rows of ``pieces``."""
    wanted = ranges.filter("z > a").withColumn("no", F.explode(F.sequence(F.floor(F.col("a") / size).cast("int"), F.floor((F.col("z") - 1) / size).cast("int"))))
    met = wanted.join(held, ["name", "no"])
    at = F.greatest(F.col("a") - F.col("no") * size, F.lit(0)).cast("int")
    part = F.substr("s", at + 1, F.least(F.col("z") - F.col("no") * size, F.lit(size)).cast("int") - at)
    return met.select("id", "no", part.alias("s")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("no", "s"))).getField("s"), "").alias("bases"))


def _end(query: str, target: str) -> tuple[int, int, int]:
    """How many bases of both, from their starts on, are alike enough, and with how many edits."""
    size = min(len(query), len(target))
    while size >= LEAST_END:
        edits = distance_of(query[:size], target[:size], int(ERRORS * size))
        if edits >= 0:
            return size, size, edits
        size //= 2
    return 0, 0, 0


def _extended(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in rows:
        out = []
        for r in part.itertuples(index=False):
            q, t = r.q_bases or "", r.r_bases or ""
            a, z = int(r.q_from - r.q_low), int(r.q_to - r.q_low)
            b, y = int(r.r_from - r.r_low), int(r.r_to - r.r_low)
            left, left_r, edits1 = _end(q[:a][::-1], t[:b][::-1])
            right, right_r, edits2 = _end(q[z:], t[y:])
            core = distance_of(q[a:z], t[b:y])
            out.append((r.id, int(r.r_from) - left_r, int(r.r_to) + right_r, left + right + z - a, core + edits1 + edits2))
        yield pd.DataFrame(out, columns=["id", "ref_start", "ref_end", "query_alignment_length", "nm"])


def align(queries: DataFrame, references: DataFrame, word: int = WORD, span: int = SPAN, often: int = OFTEN, least: int = LEAST_SEEDS) -> DataFrame:
    """Alignment records of ``queries(name, sequence)`` on ``references(name, sequence)``: ``query_name, reference_name,
    is_unmapped, is_forward, ref_start, ref_end, ref_length, query_alignment_length, nm, mismatches``."""
    q, r = (df.select("name", "sequence") for df in (queries, references))
    found = written(chains(seeds(q, r, word, span, often), least=least).withColumn("id", F.monotonically_increasing_id()), "chains")
    sizes = lambda df, name, n: df.select(F.col("name").alias(name), F.length("sequence").cast("bigint").alias(n))
    spans = found.join(sizes(q, "query", "q_size"), "query").join(sizes(r, "ref", "ref_length"), "ref")
    spans = spans.withColumns({"q_to": F.col("q_to") + word, "r_to": F.col("r_to") + word})
    before, after = F.least("q_from", "r_from"), F.least(F.col("q_size") - F.col("q_to"), F.col("ref_length") - F.col("r_to"))
    spans = spans.withColumns({"q_low": F.col("q_from") - before, "r_low": F.col("r_from") - before, "q_high": F.col("q_to") + after, "r_high": F.col("r_to") + after})
    strand = lambda a, z: (F.when(F.col("same"), F.col(a)).otherwise(F.col("q_size") - F.col(z)).alias("a"), F.when(F.col("same"), F.col(z)).otherwise(F.col("q_size") - F.col(a)).alias("z"))
    q_bases = fetched(spans.select("id", F.col("query").alias("name"), *strand("q_low", "q_high")), pieces(q)).withColumnRenamed("bases", "q_bases")
    r_bases = fetched(spans.select("id", F.col("ref").alias("name"), F.col("r_low").alias("a"), F.col("r_high").alias("z")), pieces(r)).withColumnRenamed("bases", "r_bases")
    met = spans.join(q_bases, "id").join(r_bases, "id").withColumn("q_bases", F.when(F.col("same"), F.col("q_bases")).otherwise(rc_sequence("q_bases")))
    done = met.select("id", "q_from", "q_to", "q_low", "r_from", "r_to", "r_low", "q_bases", "r_bases").mapInPandas(_extended, "id long, ref_start long, ref_end long, query_alignment_length long, nm long")
    mapped = spans.select("id", F.col("query").alias("query_name"), F.col("ref").alias("reference_name"), F.lit(False).alias("is_unmapped"), F.col("same").alias("is_forward"), "ref_length").join(done, "id")
    columns = ["query_name", "reference_name", "is_unmapped", "is_forward", "ref_start", "ref_end", "ref_length", "query_alignment_length", "nm"]
    none = q.join(found.select(F.col("query").alias("name")).distinct(), "name", "left_anti").select(F.col("name").alias("query_name"), F.lit(True).alias("is_unmapped"))
    return mapped.select(*columns).unionByName(none, allowMissingColumns=True).withColumn("mismatches", F.lit(None).cast("bigint"))


def references(targets: DataFrame, identity: float = 0.0, **settings) -> Callable[[DataFrame], DataFrame]:
    """For the stages of evidence: aligns edges (label, rc_label, sequence) to ``targets(name, sequence)`` and gives ``query,
    ref`` of both labels: references that an edge's merged alignments cover by more than a tenth of its length."""

    def aligned(edges: DataFrame) -> DataFrame:
        once = edges.filter("label <= rc_label").select(F.concat_ws("_", "label", "rc_label").alias("name"), "sequence")
        once = written(once, "queries")
        records = oriented(filtered(align(once, targets, **settings), identity))
        lengths = contig_lengths(once.withColumnRenamed("name", "header"))
        return wide_enough(merge(records), lengths).select("query", F.col("ref_id").alias("ref")).distinct()

    return aligned
