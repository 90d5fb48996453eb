"""Simplify a graph of files: ``python -m strandweave --dot G.dot --fasta G.fasta --output DIR``."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import aligner, intervals
from .plans import simplify
from .sinks import export
from .sources import bam, text


def within(low: float, high: float, kind: Callable = float) -> Callable:
    """A reader of numbers from ``low`` to ``high``, both included."""

    def read(value: str):
        number = kind(value)
        if not low <= number <= high:
            raise argparse.ArgumentTypeError(f"{value} is not within {low} and {high}")
        return number

    return read


def options() -> argparse.ArgumentParser:
    names = [s.name for s in simplify.stages(aligned=lambda edges: edges)]
    out = argparse.ArgumentParser(prog="strandweave", description="Simplify a strand-symmetric sequence graph.")
    out.add_argument("--dot", "-d", help="the graph's edges")
    out.add_argument("--fasta", "-f", help="the edges' sequences")
    out.add_argument("--restart", help="a snapshot to go on from, in place of the files")
    out.add_argument("--output", "-o", required=True, help="a folder that isn't there yet")
    out.add_argument("--alignments", "-a", help="alignments of the graph's edges, as evidence: a .bam or .sam file, or summary lines")
    out.add_argument("--multidbg", "-m", help="FASTA of references that edges next to sites are aligned to, as evidence")
    out.add_argument("--floor", type=within(0, 1e9), default=10.0, help="coverage up to which every edge goes")
    out.add_argument("--hops", type=within(1, 10, int), nargs=4, default=(3, 4, 5, 10), help="edges of a bulge's path, for the searches")
    out.add_argument("--stages", choices=names, nargs="*", help="only these stages")
    out.add_argument("--after", choices=names, help="only the stages after this one")
    out.add_argument("--contracted", type=int, help="also write a DOT file in which edges up to this length are contracted")
    out.add_argument("--snapshots", help="a folder for a snapshot after each stage")
    return out


def main(given: Sequence[str] | None = None) -> None:
    parser = options()
    args = parser.parse_args(given)
    if not args.restart and not (args.dot and args.fasta):
        parser.error("give --dot and --fasta, or --restart")
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    if args.restart:
        graph = export.load_snapshot(spark, args.restart)
    else:
        edges = text.load_graph(spark, args.dot, args.fasta)
        k = model.inferred_k(edges).first()
        if k.k_min is None or k.k_min != k.k_max:
            raise ValueError(f"overlaps from {k.k_min} to {k.k_max}")
        graph = model.Graph(edges, k.k_min)
    if args.alignments and args.multidbg:
        parser.error("give --alignments or --multidbg")
    aligned = None
    if args.alignments and args.alignments.endswith((".bam", ".sam")):
        if not args.fasta:
            parser.error("alignment records need --fasta, for the edges' lengths")
        records = bam.read_bam(spark, args.alignments) if args.alignments.endswith(".bam") else bam.sam_records(spark.read.text(args.alignments))
        merged = intervals.merge(intervals.oriented(intervals.filtered(records)))
        wide = intervals.wide_enough(merged, intervals.contig_lengths(text.read_fasta(spark, args.fasta)))
        aligned = simplify.references(wide.select("query", F.col("ref_id").alias("ref")).distinct())
    elif args.alignments:
        aligned = simplify.references(text.summary(spark.read.text(args.alignments)))
    if args.multidbg:
        aligned = aligner.references(text.read_fasta(spark, args.multidbg).select(F.split_part("header", F.lit(" "), F.lit(1)).alias("name"), "sequence"))
    plan = simplify.stages(floor=args.floor, hops=tuple(args.hops), aligned=aligned)
    if args.after:
        plan = plan[[s.name for s in plan].index(args.after) + 1 :]
    plan = [s for s in plan if args.stages is None or s.name in args.stages]
    count = iter(range(1, 1000))
    snapshot = (lambda name, g, n: export.save_snapshot(g, f"{args.snapshots}/{next(count):02d}-{name}")) if args.snapshots else None
    edges = simplify.simplify(graph, plan, snapshot).edges
    export.write_graph(edges, args.output)
    if args.contracted is not None:
        export.write_view(edges, f"{args.output}/contracted", args.contracted)


if __name__ == "__main__":
    main()
