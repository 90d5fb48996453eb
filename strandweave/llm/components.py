"""Connected components of a link table, by hooking and pointer jumping, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, saved


def _through(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its parent where it has one."""
    p = parents.select(F.col("id").alias("__id"), F.col("parent").alias("__parent"))
    return df.join(p, df[column] == p["__id"], "left").withColumn(column, F.coalesce("__parent", column)).drop("__id", "__parent")


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every end of ``links(a, b)``; ``comp`` is the smallest id that links reach.

    Each round hooks every vertex to its smallest smaller neighbour, jumps
    pointers until they end at roots, and contracts the links to roots. The
    number of links between roots falls in every round.
    """
    edges = saved(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "edges")
    labels = saved(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while not edges.isEmpty():
        parents = saved(edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent")), "parents")
        while True:
            jumped = saved(_through(parents.withColumn("was", F.col("parent")), "parent", parents), "parents")
            moved = not jumped.filter("parent <> was").isEmpty()
            drop_table(parents)
            parents = jumped
            if not moved:
                break
        new_labels = saved(_through(labels, "comp", parents), "labels")
        new_edges = _through(_through(edges, "u", parents), "v", parents)
        new_edges = saved(new_edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
        for old in (labels, edges, parents):
            drop_table(old)
        labels, edges = new_labels, new_edges
    return labels
