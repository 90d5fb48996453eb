"""Degrees, coverage of nodes, and the node predicates built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strand import kmer_node, kmer_text, rc_node


def degrees(edges: DataFrame) -> DataFrame:
    """``id, n_in, n_out`` (distinct neighbours), ``legs_in, legs_out`` (edges), ``cov_in, cov_out, self_loops``.

    One shuffle: every edge is sent to both ends; distinct neighbours and sums
    are taken in two steps, by (node, side, neighbour) and by node, where the ends are.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(True).alias("out"), F.col("dst").alias("nbr"), "multiplicity"),
        F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"), F.col("src").alias("nbr"), "multiplicity"),
    )).alias("x")).select("x.*").repartition("id")
    by_neighbour = ends.groupBy("id", "out", "nbr").agg(F.count(F.lit(1)).alias("legs"), F.sum("multiplicity").alias("cov"))
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("out") == s, c)), F.lit(0))
    one = F.lit(1).cast("bigint")
    loops = F.coalesce(F.sum(F.when(F.col("out") & (F.col("nbr") == F.col("id")), F.col("legs"))), F.lit(0))
    return by_neighbour.groupBy("id").agg(
        side(False, one).alias("n_in"), side(True, one).alias("n_out"), side(False, F.col("legs")).alias("legs_in"), side(True, F.col("legs")).alias("legs_out"),
        side(False, F.col("cov")).alias("cov_in"), side(True, F.col("cov")).alias("cov_out"), loops.alias("self_loops"),
    )


def kmer_degrees(counts: DataFrame, k: int) -> DataFrame:
    """As ``degrees``, for the graph whose edges are the (k+1)-mers ``id, multiplicity``, as numbers: no two edges join the same
    nodes there, so one step counts neighbours and edges, and nodes move as numbers."""
    src, dst = F.shiftright("id", 2), F.col("id") % (1 << 2 * k)
    ends = counts.select(F.explode(F.array(
        F.struct(src.alias("node"), F.lit(True).alias("out"), "multiplicity", (src == dst).alias("loop")),
        F.struct(dst.alias("node"), F.lit(False).alias("out"), "multiplicity", F.lit(False).alias("loop")),
    )).alias("x")).select("x.*").repartition("node")
    n_in, n_out = F.count_if(~F.col("out")), F.count_if("out")
    cover = lambda out: F.coalesce(F.sum(F.when(F.col("out") == out, F.col("multiplicity"))), F.lit(0.0))
    found = ends.groupBy("node").agg(n_in.alias("n_in"), n_out.alias("n_out"), cover(False).alias("cov_in"), cover(True).alias("cov_out"), F.count_if("loop").alias("self_loops"))
    text = found.withColumn("text", kmer_text("node", k))
    return text.select(kmer_node("text").alias("id"), "n_in", "n_out", F.col("n_in").alias("legs_in"), F.col("n_out").alias("legs_out"), "cov_in", "cov_out", "self_loops")


def non_branching(degree: DataFrame, merge_self_loop: bool = False) -> DataFrame:
    """Nodes with one way in and one way out, one leg each; with the flag also those with at most two of
    each, of which one is a self-loop."""
    unary = (F.col("legs_in") == 1) & (F.col("legs_out") == 1) & (F.col("self_loops") == 0)
    if merge_self_loop:
        looped = (F.col("self_loops") == 1) & (F.col("n_in") <= 2) & (F.col("n_out") <= 2) & (F.col("legs_in") == F.col("n_in")) & (F.col("legs_out") == F.col("n_out")) & (F.col("n_in") + F.col("n_out") > 2)
        unary = unary | looped
    return degree.filter(unary)


def tips_out(degree: DataFrame) -> DataFrame:
    """Sinks with one predecessor and one leg."""
    return degree.filter("n_out = 0 and n_in = 1 and legs_in = 1")


def tips_in(degree: DataFrame) -> DataFrame:
    """Sources with one successor and one leg."""
    return degree.filter("n_in = 0 and n_out = 1 and legs_out = 1")


def isolated_loops(degree: DataFrame) -> DataFrame:
    """Nodes whose only neighbour is themselves."""
    return degree.filter("self_loops > 0 and n_in = 1 and n_out = 1")


def two_in_two_out_nodes(degree: DataFrame) -> DataFrame:
    return degree.filter("n_in = 2 and n_out = 2 and self_loops = 0")


def two_in_two_out_edges(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """Edges from a node with two or more ways in and this only way out to one with this only way in and two or more out."""
    a = degree.filter("n_in >= 2 and n_out = 1 and self_loops = 0").select(F.col("id").alias("src"))
    b = degree.filter("n_in = 1 and n_out >= 2 and self_loops = 0").select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst").distinct()


def sites_once(sites: DataFrame, column: str = "id") -> DataFrame:
    """One of each site and its reverse complement, where both are there."""
    return sites.filter(F.col(column) <= rc_node(column))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(used, "id", "left_anti")
