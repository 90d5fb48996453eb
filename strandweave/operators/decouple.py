"""Untangling of branching nodes: by evidence that edges share, and by strands that pair up."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coverage import unbalanced
from ..functions.strand import rc_node
from ..plans.tables import written
from .degree import degrees


def support(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """``id, in_label, out_label, support, cov_in, cov_out``: how many references each way in and each way out of a site share.

    References are exploded and joined on (site, reference): no pair of edges
    is compared that has none in common; pairs without support are filled in.
    """
    ins = edges.join(sites.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("id"), F.col("label").alias("in_label"), F.col("multiplicity").alias("cov_in"), "ref_ids")
    outs = edges.join(sites.select(F.col("id").alias("src")), "src").select(F.col("src").alias("id"), F.col("label").alias("out_label"), F.col("multiplicity").alias("cov_out"), "ref_ids")
    shared = ins.select("id", "in_label", F.explode(F.array_distinct("ref_ids")).alias("ref")).join(outs.select("id", "out_label", F.explode(F.array_distinct("ref_ids")).alias("ref")), ["id", "ref"]).groupBy("id", "in_label", "out_label").agg(F.count(F.lit(1)).alias("support"))
    every = ins.drop("ref_ids").join(outs.drop("ref_ids"), "id")
    return every.join(shared, ["id", "in_label", "out_label"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("bigint")))


def accepted(matrix: DataFrame) -> DataFrame:
    """For sites with two ways in and two out, ``id, crossed, in1, in2, out1, out2``: supported both ways without
    contradiction, and with balanced coverages. Ways are numbered by label."""
    rows = matrix.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("in_label", "out_label", "support", "cov_in", "cov_out"))).alias("m")).filter(F.size("m") == 4)
    at = lambda i, f: F.get(F.col(f"m.{f}"), F.lit(i))
    straight = (at(0, "support") > 0) & (at(3, "support") > 0) & (at(1, "support") == 0) & (at(2, "support") == 0)
    crossed = (at(1, "support") > 0) & (at(2, "support") > 0) & (at(0, "support") == 0) & (at(3, "support") == 0)
    picked = rows.filter(straight | crossed).select("id", crossed.alias("crossed"), at(0, "in_label").alias("in1"), at(2, "in_label").alias("in2"), F.when(crossed, at(1, "out_label")).otherwise(at(0, "out_label")).alias("out1"), F.when(crossed, at(0, "out_label")).otherwise(at(1, "out_label")).alias("out2"), at(0, "cov_in").alias("ci1"), at(2, "cov_in").alias("ci2"), F.when(crossed, at(1, "cov_out")).otherwise(at(0, "cov_out")).alias("co1"), F.when(crossed, at(0, "cov_out")).otherwise(at(1, "cov_out")).alias("co2"))
    return picked.filter(~unbalanced("ci1", "co1") & ~unbalanced("ci2", "co2"))


def unique_refs(refs: DataFrame) -> DataFrame:
    """``id, label, ref`` without references that a site sees on two ways, or twice on one."""
    many = refs.groupBy("id", "ref").count().filter("count > 1").select("id", "ref")
    return refs.join(many, ["id", "ref"], "left_anti")


def greedy_matching(matrix: DataFrame, like: float = 1.5) -> DataFrame:
    """``id, in_label, out_label, coverage, taken_in, taken_out``: for sites of any size, supported pairs in the order of support share out
    coverages; coverages within the ratio count as equal. A small array fold for each site, no Python."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), "in_label", "out_label", F.col("cov_in").alias("ci"), F.col("cov_out").alias("co"))))
    rows = matrix.filter("support > 0").groupBy("id").agg(order.alias("p"))
    zero = F.struct(F.create_map().cast("map<string,double>").alias("used"), F.array().cast("array<struct<in_label:string,out_label:string,coverage:double,taken_in:double,taken_out:double>>").alias("done"))

    def step(state, p):
        ci = p["ci"] - F.coalesce(F.try_element_at(state["used"], F.concat(F.lit("i"), p["in_label"])), F.lit(0.0))
        co = p["co"] - F.coalesce(F.try_element_at(state["used"], F.concat(F.lit("o"), p["out_label"])), F.lit(0.0))
        low = F.least(ci, co)
        equal = F.greatest(ci, co) <= low * like
        take_in, take_out = F.when(equal, ci).otherwise(low), F.when(equal, co).otherwise(low)
        keys = F.map_from_arrays(F.array(F.concat(F.lit("i"), p["in_label"]), F.concat(F.lit("o"), p["out_label"])), F.array(p["ci"] - ci + take_in, p["co"] - co + take_out))
        others = F.map_filter(state["used"], lambda k, _: (k != F.concat(F.lit("i"), p["in_label"])) & (k != F.concat(F.lit("o"), p["out_label"])))
        new = F.struct(F.map_concat(others, keys).alias("used"), F.concat(state["done"], F.array(F.struct(p["in_label"].alias("in_label"), p["out_label"].alias("out_label"), ((take_in + take_out) / 2).alias("coverage"), take_in.alias("taken_in"), take_out.alias("taken_out")))).alias("done"))
        return F.when(low > 0.1, new).otherwise(state)

    return rows.select("id", F.explode(F.aggregate("p", zero, step)["done"]).alias("d")).select("id", "d.*")


def evidence_sites(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """``id, head, tail, mid``: nodes with several ways in and out (head and tail are the node), and edges from a
    node with several ways in to one with several out (mid is the edge's label). Sites with parallel edges or
    loops are left alone."""
    plain = degree.filter("n_in = legs_in and n_out = legs_out and self_loops = 0")
    none = F.lit(None).cast("string")
    nodes = plain.filter("n_in >= 2 and n_out >= 2").select("id", F.col("id").alias("head"), F.col("id").alias("tail"), none.alias("mid"))
    heads = plain.filter("n_in >= 2 and n_out = 1").select(F.col("id").alias("src"))
    tails = plain.filter("n_in = 1 and n_out >= 2").select(F.col("id").alias("dst"))
    mids = edges.join(heads, "src").join(tails, "dst").select(F.col("label").alias("id"), F.col("src").alias("head"), F.col("dst").alias("tail"), F.col("label").alias("mid"))
    return nodes.unionByName(mids)


def site_edges(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """The edges next to sites as edges of the site itself; around a middle edge, only references that it has too count."""
    middle = sites.join(edges.select(F.col("label").alias("mid"), F.col("ref_ids").alias("mid_refs")), "mid", "left")
    refs = F.when(F.col("mid").isNull(), F.col("ref_ids")).otherwise(F.array_intersect("ref_ids", F.coalesce("mid_refs", F.array().cast("array<string>")))).alias("ref_ids")
    ins = edges.join(middle.withColumnRenamed("head", "dst"), "dst").select("src", F.col("id").alias("dst"), "label", "multiplicity", refs)
    outs = edges.join(middle.withColumnRenamed("tail", "src"), "src").select(F.col("id").alias("src"), "dst", "label", "multiplicity", refs)
    return ins.unionByName(outs)


def strand_sites(edges: DataFrame, chains: DataFrame, strict: bool = False) -> DataFrame:
    """``head, tail, in0, in1, out0, out1``: 2-in-2-out chains where a way in is the reverse complement of a way out.

    ``chains(head, tail)`` are the unary chains between a node with two ways in
    and one with two out. One match is enough unless ``strict``; ends next to
    their own reverse complement are left alone.
    """
    ways_in = edges.groupBy(F.col("dst").alias("head")).agg(F.sort_array(F.collect_set("src")).alias("ins"))
    ways_out = edges.groupBy(F.col("src").alias("tail")).agg(F.sort_array(F.collect_set("dst")).alias("outs"))
    met = chains.join(ways_in, "head").join(ways_out, "tail").filter((F.size("ins") == 2) & (F.size("outs") == 2))
    i, o = lambda k: F.get("ins", F.lit(k)), lambda k: F.get("outs", F.lit(k))
    first, second = i(0) == rc_node(o(0)), i(1) == rc_node(o(1))
    cross1, cross2 = i(0) == rc_node(o(1)), i(1) == rc_node(o(0))
    direct = (first & second) if strict else (first | second)
    crossed = (cross1 & cross2) if strict else (cross1 | cross2)
    near_own = F.array_contains("ins", rc_node("head")) | F.array_contains("outs", rc_node("tail"))
    picked = met.filter((direct | crossed) & ~near_own)
    return picked.select("head", "tail", i(0).alias("in0"), i(1).alias("in1"), F.when(direct, o(0)).otherwise(o(1)).alias("out0"), F.when(direct, o(1)).otherwise(o(0)).alias("out1"))


def unary_chains(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """``head, tail, nodes``: from a node with two ways in and one out along nodes with one way in, to one with two out.

    Nodes behind the head have one way in and the head has two, so no walk meets a node twice: the search ends when
    none is open, or after ``hops`` edges if given."""
    degree = degrees(edges)
    heads = degree.filter("n_in = 2 and n_out = 1 and self_loops = 0").select(F.col("id").alias("head"))
    step = written(edges.select("src", "dst").distinct().join(degree.filter("n_in = 1").select(F.col("id").alias("dst"), F.col("n_out"), "self_loops"), "dst"), "steps")
    level = heads.select("head", F.col("head").alias("at"), F.array("head").alias("nodes"))
    found = None
    for _ in itertools.count() if hops is None else range(hops):
        met = written(level.join(step.select(F.col("src").alias("at"), "dst", "n_out", "self_loops"), "at").withColumn("nodes", F.concat("nodes", F.array("dst"))), "chains")
        ends = met.filter("n_out = 2 and self_loops = 0").select("head", F.col("dst").alias("tail"), "nodes")
        found = ends if found is None else found.union(ends)
        level = met.filter("n_out = 1 and dst <> head").select("head", F.col("dst").alias("at"), "nodes")
        if level.isEmpty():
            break
    return found
