"""A Spark-side convenience: coverage of edges kept up to date over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.fixtures import K, kmer_edges


def edge_coverage(reads: DataFrame, k: int = K) -> DataFrame:
    """The edges of a streaming ``reads(s)``: one stateful aggregation by (k+1)-mer, for update or complete output."""
    return kmer_edges(reads, k)
