"""Walks over nodes: consecutive steps and occurrences of a path.

A walk of up to ``HOT`` places is one window. Longer ones are cut into blocks of
``BLOCK`` places, each with the first places of the next one behind it, so that a
walk is as many tasks as it has blocks, and a path that crosses a border is seen
once, from the block where it starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import written

#: Places of a walk up to which it is one window; places of a block of a longer one.
HOT, BLOCK = 1 << 20, 1 << 18


def laid(walks: DataFrame, ahead: int, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``walk, pos, node, nth, block, own``: places numbered from 0 within their walk, with their block. The first ``ahead``
    places of a block are also, not as its own, in the one before."""
    w = walks.select("walk", "pos", "node")
    longest = w.groupBy("walk").count().agg(F.max("count")).first()[0] or 0
    if longest <= hot:
        nth = F.row_number().over(Window.partitionBy("walk").orderBy("pos")) - 1
        return w.select("*", nth.cast("bigint").alias("nth"), F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("own"))
    block = max(block, ahead)
    parts = int(w.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(w.repartitionByRange(parts, "walk", "pos").withColumn("part", F.spark_partition_id()), "walks")
    counts = ranged.groupBy("walk", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("walk", "part", (F.sum("n").over(Window.partitionBy("walk").orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("walk", "part").orderBy("pos")) - 1
    placed = ranged.withColumn("inner", inner).join(before, ["walk", "part"]).withColumn("nth", F.col("before") + F.col("inner")).withColumn("of", F.floor(F.col("nth") / block))
    halo = F.when((F.col("nth") % block < ahead) & (F.col("of") > 0), F.struct((F.col("of") - 1).alias("block"), F.lit(False).alias("own")))
    both = F.explode(F.array_compact(F.array(F.struct(F.col("of").alias("block"), F.lit(True).alias("own")), halo))).alias("b")
    return placed.select("walk", "pos", "node", "nth", both).select("walk", "pos", "node", "nth", "b.block", "b.own")


def steps(walks: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``walk, pos, node, next``"""
    order = Window.partitionBy("walk", "block").orderBy("nth")
    return laid(walks, 1, hot, block).withColumn("next", F.lead("node").over(order)).filter("own and next is not null").select("walk", "pos", "node", "next")


def edge_orders(walks: DataFrame) -> DataFrame:
    """``src, dst, positions``: where each step occurs in its walks, as one text; ``steps`` has them as rows."""
    return steps(walks).groupBy(F.col("node").alias("src"), F.col("next").alias("dst")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("walk", "pos"))), lambda x: F.concat_ws(":", x["walk"], x["pos"])), ",").alias("positions"))


def find_path(walks: DataFrame, path: list, resume: bool = False, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``walk, pos``: where the nodes of ``path`` follow one another. One window, without self-joins.

    With ``resume`` the search goes on at the last node of a match, so matches share that node at most. A match that begins
    no earlier than where the one before may end is taken whatever came before, so only runs of matches that overlap the
    next are gone through in order."""
    order = Window.partitionBy("walk", "block").orderBy("nth")
    cols = [F.lead("node", i).over(order).alias(f"n{i}") for i in range(1, len(path))]
    found = laid(walks, max(len(path) - 1, 0), hot, block).select("walk", "pos", "node", "nth", "block", "own", *cols).filter(F.col("own") & (F.col("node") == path[0]))
    for i in range(1, len(path)):
        found = found.filter(F.col(f"n{i}") == path[i])
    if not resume:
        return found.select("walk", "pos")
    step = max(len(path) - 1, 1)
    one = ["walk", "block"]
    found = written(found.select(*one, "nth", "pos"), "matches")
    across = Window.partitionBy("walk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = found.groupBy(*one).agg(F.max("nth").alias("most")).withColumn("carry", F.max("most").over(across)).drop("most")
    before = F.coalesce(F.lag("nth").over(order), "carry")
    begins = written(found.join(last, one).withColumn("begins", F.coalesce(F.col("nth") - before >= step, F.lit(True)).cast("int")).drop("carry"), "runs")
    begun = begins.groupBy(*one).agg(F.sum("begins").alias("n")).withColumn("begun", F.coalesce(F.sum("n").over(across), F.lit(0))).drop("n")
    runs = begins.join(begun, one).withColumn("run", F.col("begun") + F.sum("begins").over(order))
    hits = runs.groupBy("walk", "run").agg(F.sort_array(F.collect_list(F.struct("nth", "pos"))).alias("hits"))
    kind = dict(found.dtypes)["pos"]
    zero = F.struct(F.lit(-step).cast("bigint").alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    take = lambda s, x: F.when(x["nth"] >= s["last"] + step, F.struct(x["nth"].alias("last"), F.concat(s["kept"], F.array(x["pos"])).alias("kept"))).otherwise(s)
    return hits.select("walk", F.explode(F.aggregate("hits", zero, take)["kept"]).alias("pos"))
