"""The graph: one row for each directed edge, both strands, and the checks that hold for it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.strand import joined, kmer_node, kmer_number, rc_node, rc_sequence

#: What every edge has, and its way through the original graph: nodes, labels, and the labels of the reverse complements.
CORE = ("src", "dst", "sequence", "length", "multiplicity")
LINEAGE = ("path_nodes", "path_edges", "path_back")

EDGES = "src string, dst string, label string, rc_label string, start_base string, length bigint, multiplicity double, sequence string, ref_ids array<string>, path_nodes array<string>, path_edges array<string>, path_back array<string>"


@dataclass(frozen=True)
class Graph:
    """``edges(src, dst, length, multiplicity, sequence, ...)`` that overlap by ``k``. Nodes are the edges' ends.

    ``idle`` names the steps known to change nothing in this graph."""

    edges: DataFrame
    k: int
    idle: set[str] = field(default_factory=set, compare=False, repr=False)

    def nodes(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def core(edges: DataFrame) -> list[str]:
    """The columns that operators carry along: ``CORE``, and ``LINEAGE`` where the edges have it."""
    return [*CORE, *(c for c in LINEAGE if c in edges.columns)]


def with_lineage(edges: DataFrame) -> DataFrame:
    """Edges (label, rc_label) as their own way through the graph."""
    one = lambda c: F.array(F.coalesce(c, "label"))
    return edges.withColumns({"path_nodes": F.array("src", "dst"), "path_edges": one("label"), "path_back": one("rc_label")})


def lineage_of(parts: Column, edges: DataFrame) -> dict[str, Column]:
    """The lineage, if edges have one, of an array of edges that follow one another, as columns by name."""
    if "path_nodes" not in edges.columns:
        return {}
    nodes = F.transform(parts["path_nodes"], lambda x, i: F.when(i == 0, x).otherwise(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))))
    return {"path_nodes": F.flatten(nodes), "path_edges": F.flatten(parts["path_edges"]), "path_back": F.flatten(parts["path_back"])}


def chained(parts: Column, k: int, edges: DataFrame) -> dict[str, Column]:
    """The sequence and the lineage of an array of edges that follow one another, as columns by name."""
    return {"sequence": joined(parts["sequence"], k)} | lineage_of(parts, edges)


def mirrored(edges: DataFrame) -> DataFrame:
    """The reverse complements of edges, with the same columns of ``core``."""
    back = {"path_nodes": F.reverse(F.transform("path_nodes", rc_node)), "path_edges": F.reverse("path_back"), "path_back": F.reverse("path_edges")} if "path_nodes" in edges.columns else {}
    return edges.select(rc_node("dst").alias("src"), rc_node("src").alias("dst"), rc_sequence("sequence").alias("sequence"), "length", "multiplicity", *(c.alias(n) for n, c in back.items()))


def labelled(edges: DataFrame, k: int) -> DataFrame:
    """Edges with labels ``<src>.<n>``, in the order of (dst, sequence) within a source, and the labels of
    their reverse complements. Deterministic, whatever the partitioning. An edge and its reverse complement meet under one
    name, the lesser of both."""
    order = Window.partitionBy("src").orderBy("dst", "sequence")
    drop = [c for c in ("label", "rc_label") if c in edges.columns]
    named = edges.drop(*drop).withColumn("label", F.concat("src", F.lit("."), F.row_number().over(order)))
    own, back = F.struct("src", "dst", "sequence"), F.struct(rc_node("dst").alias("src"), rc_node("src").alias("dst"), rc_sequence("sequence").alias("sequence"))
    met = Window.partitionBy("__both")
    label = lambda forward: F.max(F.when(F.col("__forward") == forward, F.col("label"))).over(met)
    both = named.withColumn("__forward", own <= back).withColumn("__self", own == back).withColumn("__both", F.least(own, back))
    twin = F.when(F.col("__self"), F.col("label")).when(F.col("__forward"), label(False)).otherwise(label(True))
    found = both.withColumn("rc_label", twin).drop("__forward", "__self", "__both")
    first = ["src", "dst", "sequence"]
    return found.select(*first, *(c for c in found.columns if c not in first)).withColumn("start_base", F.substr("sequence", F.lit(k + 1), F.lit(1)))


def ranked(sequences: DataFrame, k: int) -> DataFrame:
    """Adds ``n``, the number in a label, to edges ``sequence, multiplicity`` of a k-mer graph, where nodes are the ends of
    sequences, and ``beside``: whether the source has two edges to one node. Nodes are made after the shuffle, not before."""
    here = sequences.withColumn("src", kmer_number(F.substr("sequence", F.lit(1), F.lit(k)))).repartition("src")
    here = here.withColumn("dst", kmer_node(F.substr("sequence", F.length("sequence") - k + 1, F.lit(k))))
    numbered = here.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst", "sequence")))
    # edges to one node are next to one another in that order
    last = F.lag("dst").over(Window.partitionBy("src").orderBy("dst", "sequence"))
    return numbered.withColumn("same", F.coalesce(F.col("dst") == last, F.lit(False))).withColumn("beside", F.max("same").over(Window.partitionBy("src"))).drop("src", "dst", "same")


def paired(sequences: DataFrame) -> DataFrame:
    """``sequence, multiplicity, n, beside`` with ``rc_n, rc_beside`` of the reverse complement, null where it isn't there."""
    own, back = F.col("sequence"), rc_sequence("sequence")
    here = sequences.select(F.least(own, back).alias("both"), (own <= back).alias("forward"), "multiplicity", "n", "beside").repartition("both")
    met = Window.partitionBy("both")
    other = F.when(F.col("both") == rc_sequence("both"), F.col("own"))
    for forward in (True, False):
        other = other.when(F.col("forward") == forward, F.max(F.when(F.col("forward") != forward, F.col("own"))).over(met))
    found = here.withColumn("own", F.struct("n", "beside")).withColumn("other", other)
    return found.select(F.when(F.col("forward"), F.col("both")).otherwise(rc_sequence("both")).alias("sequence"), "multiplicity", "n", "beside", F.col("other.n").alias("rc_n"), F.col("other.beside").alias("rc_beside"))


def kmer_labelled(numbered: DataFrame, k: int) -> DataFrame:
    """The columns of ``labelled`` from those of ``paired``."""
    end = F.substr("sequence", F.length("sequence") - k + 1, F.lit(k))
    e = numbered.select(kmer_node(F.substr("sequence", F.lit(1), F.lit(k))).alias("src"), kmer_node(end).alias("dst"), "sequence", (F.length("sequence") - k).cast("bigint").alias("length"), "multiplicity", "n", "rc_n")
    return e.select("src", "dst", "sequence", "length", "multiplicity", F.concat("src", F.lit("."), "n").alias("label"), F.concat(rc_node("dst"), F.lit("."), "rc_n").alias("rc_label"), F.substr("sequence", F.lit(k + 1), F.lit(1)).alias("start_base"))


def inferred_k(edges: DataFrame) -> DataFrame:
    """``k_min, k_max, n_edges``: the overlap is constant where both are equal."""
    k = F.length("sequence") - F.col("length")
    return edges.agg(F.min(k).cast("bigint").alias("k_min"), F.max(k).cast("bigint").alias("k_max"), F.count(F.lit(1)).alias("n_edges"))


def violations(graph: Graph) -> DataFrame:
    """``check, n``: rows that break a check. Strand symmetry, unique labels, lengths, palindromes."""
    e = graph.edges
    twin = e.select(rc_node("dst").alias("src"), rc_node("src").alias("dst"), rc_sequence("sequence").alias("sequence"))
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    out = [
        count("strand symmetry", e.join(twin, ["src", "dst", "sequence"], "left_anti")),
        count("length", e.filter(F.col("length") != F.length("sequence") - graph.k)),
        count("palindrome", e.filter((F.col("sequence") == rc_sequence("sequence")) & (F.col("src") != rc_node("dst")))),
    ]
    if "label" in e.columns:
        out.append(count("label", e.groupBy("label").count().filter("count > 1")))
    if "path_nodes" in e.columns:
        out.append(count("lineage", e.filter(F.size("path_nodes") != F.size("path_edges") + 1)))
    whole = out[0]
    for df in out[1:]:
        whole = whole.union(df)
    return whole
