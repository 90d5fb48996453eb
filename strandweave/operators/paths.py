"""Bounded path search, and the bulges that two paths make."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alignment
from ..functions.coverage import TOLERANCE, ratio, step_coverage
from ..functions.strand import joined, kmer_number, node_of, node_text, rc_node
from ..plans.tables import written


def steps(edges: DataFrame) -> DataFrame:
    """What a path needs of an edge; sequences stay out of the search."""
    return edges.select("src", "dst", "label", "length", "multiplicity", step_coverage("multiplicity", "src", "dst").alias("usable"))


def khop(edges: DataFrame, hops: int, allow_rc: bool = False, branching_only: bool = True) -> DataFrame:
    """``start, end, nodes, labels, length, weight, min_cov``: simple paths of at most ``hops`` edges.

    Paths start at nodes with two or more successors. A node is not met twice,
    nor, unless allowed, is its reverse complement. Every hop is one join of
    the open paths with the steps on the end node; hops are written out, so
    that plans stay short and no hop is walked twice. Successors are counted
    where a node's steps are, after the shuffle that the first hop takes.
    """
    e = steps(edges)
    first = e
    if branching_only:
        here = Window.partitionBy("src")
        first = e.withColumn("many", F.min("dst").over(here) != F.max("dst").over(here)).filter("many")
    first = first.filter("src <> dst")
    if not allow_rc:
        first = first.filter(F.col("dst") != rc_node("src"))
    level = first.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("nodes"), F.array("label").alias("labels"), "length", (F.col("multiplicity") * F.col("length")).alias("weight"), F.col("usable").alias("min_cov"))
    levels = [level]
    for hop in range(1, hops):
        if hop > 1:
            levels[-1] = level = written(level, "paths")
        new = F.col("dst")
        meets = ~F.array_contains("nodes", new)
        if not allow_rc:
            meets = meets & ~F.array_contains("nodes", rc_node(new))
        longer = level.join(e.select(F.col("src").alias("end"), "dst", "label", F.col("length").alias("l"), "multiplicity", "usable"), "end").filter(meets)
        level = longer.select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("labels", F.array("label")).alias("labels"), (F.col("length") + F.col("l")).alias("length"), (F.col("weight") + F.col("multiplicity") * F.col("l")).alias("weight"), F.least("min_cov", "usable").alias("min_cov"))
        levels.append(level)
    return functools.reduce(DataFrame.unionByName, levels)


#: Bits of a step's number that hold the number in its label: at most four edges leave a node of a k-mer graph.
BITS = 3


def kmer_steps(numbered: DataFrame, k: int) -> DataFrame:
    """``src, dst, step, back, length, multiplicity, usable`` of a k-mer graph's edges ``sequence, multiplicity, n, rc_n``, where
    all that moves is numbers: nodes, and a step's own (its source and the number in its label) with that of its reverse
    complement."""
    mirror = F.lit(1 << 2 * k)
    end = lambda at: node_of(kmer_number(F.substr("sequence", at, F.lit(k))), k)
    e = numbered.select(end(F.lit(1)).alias("src"), end(F.length("sequence") - k + 1).alias("dst"), "n", "rc_n", (F.length("sequence") - k).cast("bigint").alias("length"), "multiplicity")
    step = lambda node, n: F.shiftleft(node, BITS) + F.col(n).cast("bigint")
    usable = F.when(F.col("src") == F.col("dst").bitwiseXOR(mirror), F.col("multiplicity") / 2).otherwise(F.col("multiplicity"))
    return e.select("src", "dst", step(F.col("src"), "n").alias("step"), step(F.col("dst").bitwiseXOR(mirror), "rc_n").alias("back"), "length", "multiplicity", usable.alias("usable"))


#: What a path adds up over its steps, by name: from a step's columns (``t_...``), and from itself and the next step's.
MEASURES = {
    "length": (lambda: F.col("t_length"), lambda: F.col("length") + F.col("t_length")),
    "weight": (lambda: F.col("t_multiplicity") * F.col("t_length"), lambda: F.col("weight") + F.col("t_multiplicity") * F.col("t_length")),
    "min_cov": (lambda: F.col("t_usable"), lambda: F.least("min_cov", "t_usable")),
}


def khop_numbers(steps_: DataFrame, hops: int, k: int, measures: dict | None = None) -> DataFrame:
    """The paths of ``khop`` over ``kmer_steps``, as numbers: ``step1, ..., end`` (null after the last step) and the ``measures``.
    Nodes in between follow from the steps, and names from both, once no row moves any more."""
    mirror, measures = F.lit(1 << 2 * k), measures or {}
    more = steps_.select(*(F.col(c).alias(f"t_{c}") for c in steps_.columns))
    here = Window.partitionBy("t_src")
    first = more.withColumn("many", F.min("t_dst").over(here) != F.max("t_dst").over(here)).filter("many and t_src <> t_dst").filter(F.col("t_dst") != F.col("t_src").bitwiseXOR(mirror))
    level = first.select(F.col("t_step").alias("step1"), F.col("t_dst").alias("end"), *(begin().alias(name) for name, (begin, _) in measures.items()))
    levels = [level]
    for hop in range(2, hops + 1):
        if hop > 2:
            levels[-1] = level = written(level, "paths")
        met = level.join(more, level["end"] == more["t_src"])
        for node in (*(F.shiftright(f"step{i}", BITS) for i in range(1, hop)), F.col("end")):
            met = met.filter((F.col("t_dst") != node) & (F.col("t_dst") != node.bitwiseXOR(mirror)))
        level = met.select(*(f"step{i}" for i in range(1, hop)), F.col("t_step").alias(f"step{hop}"), F.col("t_dst").alias("end"), *(onward().alias(name) for name, (_, onward) in measures.items()))
        levels.append(level)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)


def _step_columns(paths: DataFrame) -> list[str]:
    return [c for c in paths.columns if c.startswith("step") and c[4:].isdigit()]


def _label(node: Column, number: Column) -> Column:
    return F.concat(node, F.lit("."), number.cast("string"))


def _number(step: Column | str) -> Column:
    """The number in the label of a step, of a step's number."""
    return (F.col(step) if isinstance(step, str) else step).bitwiseAND(F.lit((1 << BITS) - 1))


def named(paths: DataFrame, k: int) -> DataFrame:
    """Paths of ``khop_numbers`` with the columns ``start, end, nodes, labels`` instead of numbers."""
    steps_ = _step_columns(paths)
    rest = [c for c in paths.columns if c not in (*steps_, "end")]
    p = paths.select(*steps_, *(node_text(F.shiftright(c, BITS), k).alias(f"node{c[4:]}") for c in steps_), node_text("end", k).alias("end"), *rest)
    nodes = [F.col(f"node{c[4:]}") for c in steps_]
    return p.select(nodes[0].alias("start"), "end", F.array_compact(F.array(*nodes, F.col("end"))).alias("nodes"), F.array_compact(F.array(*(_label(n, _number(c)) for n, c in zip(nodes, steps_)))).alias("labels"), *rest)


def safe_numbers(steps_: DataFrame, hops: int, k: int) -> DataFrame:
    """The paths of ``khop`` over ``kmer_steps``, as numbers, with ``safe``: as ``unsafe_steps`` has it. What decides is kept along
    the way: ``tight``, the least coverage of those steps that are the only way into the inner node behind them or out of the
    one before them, and less than any where an inner node has a self-loop."""
    lowest, into = F.lit(float("-inf")), Window.partitionBy("dst")
    marked = steps_.select("src", "dst", "step", "multiplicity", "usable", F.when(F.max(F.col("src") == F.col("dst")).over(into), lowest).when(F.count(F.lit(1)).over(into) == 1, F.col("multiplicity")).alias("behind"))
    flags = written(marked, "flags").withColumn("ahead", F.when(F.count(F.lit(1)).over(Window.partitionBy("src")) == 1, F.col("multiplicity")))
    measures = {
        "min_cov": MEASURES["min_cov"],
        "tight": (lambda: F.lit(None).cast("double"), lambda: F.least("tight", "behind", "t_ahead")),
        "behind": (lambda: F.col("t_behind"), lambda: F.col("t_behind")),
    }
    found = khop_numbers(flags, hops, k, measures)
    return found.withColumn("safe", ~F.coalesce(F.col("tight") - TOLERANCE < F.col("min_cov"), F.lit(False))).drop("min_cov", "tight", "behind")


def reverse_numbers(steps_: DataFrame, hops: int, k: int) -> DataFrame:
    """``labels, rc_labels`` of the paths of ``khop`` over ``kmer_steps``, as ``reverse_labels`` has them. The nodes on the other
    strand follow from the path's own; of a step's reverse complement only the number in its label is carried."""
    own = F.coalesce(_number("t_back"), F.lit(0))
    p = khop_numbers(steps_, hops, k, {"backs": (lambda: own, lambda: F.shiftleft("backs", BITS) + own)})
    names = _step_columns(p)
    there = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.lit(1))
    back = []
    for i, c in enumerate(names, 1):
        behind = F.coalesce(*(F.shiftright(n, BITS) for n in names[i : i + 1]), "end")
        number = _number(F.call_function("shiftright", F.col("backs"), (there - i) * BITS))
        back.append(F.when(F.col(c).isNotNull() & (number > 0), _label(node_text(behind.bitwiseXOR(F.lit(1 << 2 * k)), k), number)))
    kept = p.withColumn("rc_labels", F.array_compact(F.array(*reversed(back)))).drop("backs").filter(F.size("rc_labels") > 0)
    return named(kept, k).select("labels", "rc_labels")


def sharing_ends(steps_: DataFrame, hops: int, k: int) -> DataFrame:
    """Those paths of ``khop`` over ``kmer_steps`` whose start and end another one has too, with its columns: bulges are made
    of no others, and few paths share their ends. All paths meet as rows of a few numbers; measures and names are fetched
    for those that stay."""
    found = khop_numbers(steps_, hops, k)
    mates = Window.partitionBy(F.shiftright("step1", BITS), "end")
    few = written(found.withColumn("mates", F.count(F.lit(1)).over(mates)).filter("mates > 1").select(F.array_compact(F.array(*_step_columns(found))).alias("steps"), "end"), "sharing")
    own = ["length", "multiplicity", "usable"]
    met = few.select("steps", "end", F.posexplode("steps").alias("at", "step")).join(steps_.select("step", *own), "step")
    along = met.groupBy("steps", "end").agg(F.sort_array(F.collect_list(F.struct("at", *own))).alias("x"))
    weight = F.aggregate("x", F.lit(0.0), lambda w, s: w + s["multiplicity"] * s["length"])
    length = F.aggregate("x", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    flat = along.select(*(F.get("steps", F.lit(i)).alias(f"step{i + 1}") for i in range(hops)), "end", length.alias("length"), weight.alias("weight"), F.array_min("x.usable").alias("min_cov"))
    return named(flat, k)


def _distances(steps_: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """``id, away``: nodes that ``steps_(u, v)`` reach from ``roots(id)`` in at most ``hops``, with the least number of steps."""
    known = written(roots.select("id").distinct().withColumn("away", F.lit(0)), "reached")
    newest = known
    for step in range(1, hops + 1):
        newest = newest.select(F.col("id").alias("u")).join(steps_, "u").select(F.col("v").alias("id")).distinct().join(known, "id", "left_anti")
        newest = written(newest.withColumn("away", F.lit(step)), "reached")
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
    return known


def halves(edges: DataFrame, hops: int, allow_rc: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Halves of the paths that bulges can be made of: from a node with two or more successors to a node with two or more
    edges in. ``start, end, ..., hop`` from the start, ``hop`` edges up to half of ``hops``; and ``mid, end, ...`` with the
    rest of them, to the end. Also the number of edges of the longest first half.

    Steps that can't be part of a path of ``hops`` edges are never walked: least distances from starts and to ends, a table
    of nodes, tell that."""
    e = steps(edges).filter("src <> dst")
    if not allow_rc:
        e = e.filter(F.col("dst") != rc_node("src"))
    one = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    starts = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).count().filter("count > 1").select("id")
    ends = edges.groupBy(F.col("dst").alias("id")).count().filter("count > 1").select("id")
    behind = _distances(one, starts, hops).select(F.col("id").alias("src"), F.col("away").alias("behind"))
    ahead = _distances(one.select(F.col("v").alias("u"), F.col("u").alias("v")), ends, hops).select(F.col("id").alias("dst"), F.col("away").alias("ahead"))
    live = written(e.join(behind, "src").join(ahead, "dst").filter(F.col("behind") + 1 + F.col("ahead") <= hops), "live")
    first = -(-hops // 2)
    row = [F.array("src", "dst").alias("nodes"), F.array("label").alias("labels"), "length", (F.col("multiplicity") * F.col("length")).alias("weight"), F.col("usable").alias("min_cov")]
    more = [F.col("label"), F.col("length").alias("l"), "multiplicity", "usable"]
    grown = [(F.col("length") + F.col("l")).alias("length"), (F.col("weight") + F.col("multiplicity") * F.col("l")).alias("weight"), F.least("min_cov", "usable").alias("min_cov")]

    def meets(node: str) -> Column:
        new = ~F.array_contains("nodes", F.col(node))
        return new if allow_rc else new & ~F.array_contains("nodes", rc_node(node))

    level = written(live.filter("behind = 0").select(F.col("src").alias("start"), F.col("dst").alias("end"), *row, "ahead", F.lit(1).alias("hop")), "forward")
    forward = level
    for hop in range(2, first + 1):
        met = level.drop("ahead", "hop").join(live.select(F.col("src").alias("end"), "dst", "ahead", *more), "end").filter(meets("dst") & (F.col("ahead") + hop <= hops))
        level = written(met.select("start", F.col("dst").alias("end"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("labels", F.array("label")).alias("labels"), *grown, "ahead", F.lit(hop).alias("hop")), "forward")
        forward = forward.unionByName(level)
    if hops == first:
        return forward, forward.limit(0).withColumnRenamed("start", "mid"), first
    # a second half begins where a whole first half ends
    mids = level.select(F.col("end").alias("mid")).distinct()
    level = written(live.filter("ahead = 0").select(F.col("src").alias("mid"), F.col("dst").alias("end"), *row, "behind"), "backward")
    backward = level
    for hop in range(2, hops - first + 1):
        met = level.drop("behind").join(live.select("src", F.col("dst").alias("mid"), "behind", *more), "mid").filter(meets("src") & (F.col("behind") + hop <= hops))
        level = written(met.select(F.col("src").alias("mid"), "end", F.concat(F.array("src"), "nodes").alias("nodes"), F.concat(F.array("label"), "labels").alias("labels"), *grown, "behind"), "backward")
        backward = backward.unionByName(level)
    return forward, backward.join(mids, "mid", "left_semi"), first


def two_ended(edges: DataFrame, hops: int, allow_rc: bool = False) -> DataFrame:
    """Those paths of ``khop`` that bulges can be made of, whose end has two or more edges in, found from both ends: halves
    of up to half of the edges are joined on the node in the middle, if they have no other node in common."""
    forward, backward, first = halves(edges, hops, allow_rc)
    columns = ["start", "end", "nodes", "labels", "length", "weight", "min_cov"]
    short = forward.filter("ahead = 0").select(*columns)
    back = backward.select("mid", *(F.col(c).alias(f"{c}2") for c in columns[1:]))
    met = forward.filter(F.col("hop") == first).withColumnRenamed("end", "mid").join(back, "mid")
    rest = F.slice("nodes2", 2, F.size("nodes2") - 1)
    apart = ~F.arrays_overlap("nodes", rest)
    if not allow_rc:
        apart = apart & ~F.arrays_overlap("nodes", F.transform(rest, rc_node))
    both = met.filter(apart).select("start", F.col("end2").alias("end"), F.concat("nodes", rest).alias("nodes"), F.concat("labels", "labels2").alias("labels"), (F.col("length") + F.col("length2")).alias("length"), (F.col("weight") + F.col("weight2")).alias("weight"), F.least("min_cov", "min_cov2").alias("min_cov"))
    return short.unionByName(both)


def interior(nodes: Column | str) -> Column:
    n = F.col(nodes) if isinstance(nodes, str) else nodes
    return F.slice(n, 2, F.greatest(F.size(n) - 2, F.lit(0)))


def _arrows(nodes: Column) -> Column:
    """The steps of a path, as strings."""
    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), lambda i: F.concat_ws(">", F.get(nodes, i), F.get(nodes, i + 1)))


def reversed_nodes(nodes: Column) -> Column:
    return F.reverse(F.transform(nodes, rc_node))


def bulge_pairs(paths: DataFrame, identity: float, allow_rc: bool = False, edges: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Pairs of paths with the same ends whose interiors share no node, and that are alike enough: by their lengths, or,
    where ``edges`` are given, by the aligned columns of their sequences over the longer one's length.

    With ``allow_rc`` interiors share no node of the other's reverse complement either, nor is any step of one a step of
    the other on either strand."""
    key = F.array_join("labels", ",")
    p = paths.withColumn("key", key)
    mine = ["nodes", "labels", "length", "weight", "min_cov", "key"]
    a = p.select("start", "end", *(F.col(c).alias(f"{c}1") for c in mine))
    b = p.select("start", "end", *(F.col(c).alias(f"{c}2") for c in mine))
    near = ratio("length1", "length2") >= identity  # a quotient is exact where it equals the bound; (1 - identity) isn't
    apart = ~F.arrays_overlap(interior("nodes1"), F.col("nodes2")) & ~F.arrays_overlap(interior("nodes2"), F.col("nodes1"))
    if allow_rc:
        one, two = F.col("nodes1"), F.col("nodes2")
        single = (F.size("labels1") == 1) & (F.size("labels2") == 1)  # parallel edges are one step of nodes
        apart = apart & ~F.arrays_overlap(interior("nodes1"), F.transform(interior("nodes2"), rc_node)) & (single | ~F.arrays_overlap(_arrows(one), F.concat(_arrows(two), _arrows(reversed_nodes(two)))))
    pairs = a.join(b, ["start", "end"]).filter((F.col("key1") < F.col("key2")) & near & apart)
    pairs = pairs.withColumn("n_edges", F.size("labels1") + F.size("labels2"))
    if edges is None:
        return pairs.withColumn("identity", ratio("length1", "length2")).filter(F.col("identity") >= identity)
    # sequences are fetched for the paths of pairs only
    used = pairs.select(F.explode(F.array(F.struct(F.col("key1").alias("key"), F.col("labels1").alias("labels")), F.struct(F.col("key2").alias("key"), F.col("labels2").alias("labels")))).alias("p")).select("p.*").dropDuplicates(["key"])
    pos = used.select("key", F.posexplode("labels").alias("at", "label")).join(edges.select("label", "sequence"), "label")
    whole = pos.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "sequence"))).alias("s")).select("key", joined(F.col("s.sequence"), k).alias("sequence"))
    for i in ("1", "2"):
        pairs = pairs.join(whole.select(F.col("key").alias(f"key{i}"), F.col("sequence").alias(f"__s{i}")), f"key{i}")
    columns = alignment.aligned("__s1", "__s2").getField("aligned_columns")
    return pairs.withColumn("identity", columns / F.greatest(F.length("__s1"), F.length("__s2"))).drop("__s1", "__s2").filter(F.col("identity") >= identity)


def best_pairs(pairs: DataFrame) -> DataFrame:
    """For each pair of ends the most alike paths; then fewer edges; then the smaller labels."""
    order = Window.partitionBy("start", "end").orderBy(F.desc("identity"), "n_edges", "key1", "key2")
    return pairs.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def conflicts(bulges: DataFrame) -> DataFrame:
    """``start, end``: bulges with a leg whose interior another bulge's leg has too, with just one end in common."""
    legs = bulges.select("start", "end", F.explode(F.array("nodes1", "nodes2")).alias("n")).withColumn("inside", F.array_join(interior("n"), ",")).filter("inside <> ''")
    a, b = legs.select("start", "end", "inside"), legs.select(F.col("start").alias("s"), F.col("end").alias("e"), "inside")
    clash = (F.col("start") == F.col("s")) & (F.col("end") != F.col("e")) | (F.col("start") != F.col("s")) & (F.col("end") == F.col("e"))
    return a.join(b, "inside").filter(clash).select("start", "end").distinct()


def _degrees_along(paths: DataFrame, column: str, degree: DataFrame) -> DataFrame:
    """Arrays of the degrees of a path's inner nodes, in order, as ``<column>_deg``."""
    inner = paths.select("start", "end", "key1", "key2", F.posexplode(interior(column)).alias("at", "id"))
    with_degree = inner.join(degree.select("id", "n_in", "n_out", "self_loops"), "id")
    seen = with_degree.groupBy("start", "end", "key1", "key2").agg(F.sort_array(F.collect_list(F.struct("at", "n_in", "n_out", "self_loops"))).alias(f"{column}_deg"))
    return paths.join(seen, ["start", "end", "key1", "key2"], "left")


def two_in_two_out_inside(deg: str) -> Column:
    """Whether a path comes in where others do and later leaves where others do: at inner places i <= j."""
    d = F.coalesce(F.col(deg), F.array().cast("array<struct<at:int,n_in:bigint,n_out:bigint,self_loops:bigint>>"))
    enters = lambda x: (x["n_in"] - F.when(x["self_loops"] > 0, 1).otherwise(0)) > 1
    leaves = lambda x: (x["n_out"] > 2) | (x["n_out"] == 2) & (x["self_loops"] == 0)
    return F.exists(d, lambda x: enters(x) & F.exists(d, lambda y: (y["at"] >= x["at"]) & leaves(y)))


def two_in_two_out_parts(nodes: str, deg: str) -> Column:
    """The sub-paths from the node before each inner place i where others come in to the node after each j >= i where
    others leave, as arrays of nodes."""
    d = F.coalesce(F.col(deg), F.array().cast("array<struct<at:int,n_in:bigint,n_out:bigint,self_loops:bigint>>"))
    enters = F.filter(d, lambda x: (x["n_in"] - F.when(x["self_loops"] > 0, 1).otherwise(0)) > 1)
    leaves = F.filter(d, lambda x: (x["n_out"] > 2) | (x["n_out"] == 2) & (x["self_loops"] == 0))
    part = lambda x: F.transform(F.filter(leaves, lambda y: y["at"] >= x["at"]), lambda y: F.slice(F.col(nodes), x["at"] + 1, y["at"] - x["at"] + 3))
    return F.flatten(F.transform(enters, part))


def with_parts(bulges: DataFrame, degree: DataFrame) -> DataFrame:
    """Adds ``parts1, parts2``: the 2-in-2-out sub-paths inside either leg."""
    out = _degrees_along(_degrees_along(bulges, "nodes1", degree), "nodes2", degree)
    return out.withColumn("parts1", two_in_two_out_parts("nodes1", "nodes1_deg")).withColumn("parts2", two_in_two_out_parts("nodes2", "nodes2_deg")).drop("nodes1_deg", "nodes2_deg")


def with_security(bulges: DataFrame, degree: DataFrame) -> DataFrame:
    """Adds ``mixed1, mixed2``: a 2-in-2-out inside either leg."""
    out = _degrees_along(_degrees_along(bulges, "nodes1", degree), "nodes2", degree)
    return out.withColumn("mixed1", two_in_two_out_inside("nodes1_deg")).withColumn("mixed2", two_in_two_out_inside("nodes2_deg")).drop("nodes1_deg", "nodes2_deg")


def secure(bulges: DataFrame, level: int) -> DataFrame:
    """3: neither leg has a 2-in-2-out inside; 2: one hasn't; else all."""
    return bulges.filter(~F.col("mixed1") & ~F.col("mixed2")) if level == 3 else bulges.filter(~F.col("mixed1") | ~F.col("mixed2")) if level == 2 else bulges


def unsafe_steps(paths: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """``key``: paths (key, labels, min_cov) whose extraction would leave an inner node without a way in or out, or that pass a self-loop."""
    pos = paths.select("key", "min_cov", F.size("labels").alias("n"), F.posexplode("labels").alias("at", "label"))
    e = pos.join(edges.select("label", "src", "dst", "multiplicity"), "label")
    spent = F.col("multiplicity") - TOLERANCE < F.col("min_cov")
    into = e.filter("at < n - 1").select("key", F.col("dst").alias("id"), spent.alias("spent"), F.lit(True).alias("enters"))
    outof = e.filter("at > 0").select("key", F.col("src").alias("id"), spent.alias("spent"), F.lit(False).alias("enters"))
    met = into.union(outof).join(degree, "id")
    alone = F.when(F.col("enters"), F.col("legs_in") == 1).otherwise(F.col("legs_out") == 1)
    return met.filter(F.col("spent") & alone | (F.col("self_loops") > 0)).select("key").distinct()


def self_reverse_halved(paths: DataFrame) -> DataFrame:
    """Adds ``usable_cov``: half of the least coverage where a path and its reverse complement share a step."""
    nodes = F.col("nodes")
    return paths.withColumn("usable_cov", F.when(F.arrays_overlap(_arrows(nodes), _arrows(reversed_nodes(nodes))), F.col("min_cov") / 2).otherwise(F.col("min_cov")))


def reverse_labels(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, rc_labels``: the labels of the reverse complement of each path (key, labels). Edges whose reverse complement
    isn't there have none, and paths of only such edges no row."""
    pos = paths.select("key", F.posexplode("labels").alias("at", "label")).join(edges.filter("rc_label is not null").select("label", "rc_label"), "label")
    back = F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("at"), "rc_label")))
    return pos.groupBy("key").agg(back.alias("x")).select("key", F.col("x.rc_label").alias("rc_labels"))
