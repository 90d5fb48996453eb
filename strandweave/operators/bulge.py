"""Parallel edges (simple bulges): folds into one edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strand import rc_node
from ..model import LINEAGE


def parallel_legs(edges: DataFrame) -> DataFrame:
    """``src, dst, legs, length_max, length_min, coverage`` of node pairs with more than one edge."""
    grouped = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("legs"), F.max("length").alias("length_max"), F.min("length").alias("length_min"), F.sum("multiplicity").alias("coverage"))
    return grouped.filter("legs > 1")


def collapse(edges: DataFrame, skip_rc: bool = True) -> DataFrame:
    """``src, dst, sequence, length, multiplicity`` and the lineage, if any: of parallel edges the longest stays, then the most covered,
    then the first by sequence; its coverage is the sum. One aggregation with map-side combination.

    Edges from a node to its own reverse complement are left alone with ``skip_rc``.
    """
    more = [c for c in LINEAGE if c in edges.columns]
    best = F.max_by(F.struct("sequence", "length", *more), F.struct("length", "multiplicity", _descending("sequence")))
    own = F.col("dst") == rc_node("src")
    key = F.when(own & F.lit(skip_rc), F.col("sequence")).otherwise(F.lit(""))
    grouped = edges.withColumn("__leg", key).groupBy("src", "dst", "__leg").agg(best.alias("b"), F.sum("multiplicity").alias("multiplicity"))
    return grouped.select("src", "dst", "b.sequence", "b.length", "multiplicity", *(f"b.{c}" for c in more))


def _descending(column: str):
    """Orders strings of A, C, G, T the other way round."""
    return F.translate(column, "ACGT", "TGCA")


def fold(edges: DataFrame, skip_rc: bool = True) -> DataFrame:
    """As ``collapse``, but leg by leg in the order of (length, multiplicity, sequence) as they come: a leg
    replaces the kept one when it is longer, or as long and covered more than what has been added up so far."""
    legs = F.sort_array(F.collect_list(F.struct("sequence", "length", "multiplicity")))
    own = F.col("dst") == rc_node("src")
    key = F.when(own & F.lit(skip_rc), F.col("sequence")).otherwise(F.lit(""))
    grouped = edges.withColumn("__leg", key).groupBy("src", "dst", "__leg").agg(legs.alias("legs"))

    def add(kept, leg):
        wins = (leg["length"] > kept["length"]) | (leg["length"] == kept["length"]) & (leg["multiplicity"] > kept["multiplicity"])
        total = (kept["multiplicity"] + leg["multiplicity"]).alias("multiplicity")
        return F.struct(F.when(wins, leg["sequence"]).otherwise(kept["sequence"]).alias("sequence"), F.when(wins, leg["length"]).otherwise(kept["length"]).alias("length"), total)

    rest = F.slice("legs", 2, F.greatest(F.size("legs") - 1, F.lit(0)))
    return grouped.select("src", "dst", F.aggregate(rest, F.get("legs", F.lit(0)), add).alias("b")).select("src", "dst", "b.sequence", "b.length", "b.multiplicity")
