"""Graph files: FASTA, DOT, alignment summaries. All lines are parsed by built-in functions, in parallel.

Malformed lines: DOT lines without "[" are skipped, summary lines with fewer
than four fields too. Null or empty lines are skipped everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strand import rc_node, rc_sequence

_EDGE = r'^\s*"([^"]+)"\s*->\s*"([^"]+)"\s*\[label="(\S+) (\S) (\d+)\(([0-9.eE+-]+)\)"'


def fasta_records(chunks: DataFrame) -> DataFrame:
    """``header, sequence`` of ``chunks(value)``: the text from one record's start to the next; sequences may be wrapped.

    A chunk without a header line and a sequence of its own has the empty sequence; chunks of blanks are skipped."""
    own = F.regexp_replace("value", r"^\s*>?", "")
    line = F.regexp_extract(own, r"^[^\r\n]*", 0)
    rows = chunks.filter(F.length(F.trim("value")) > 0).select(F.trim(line).alias("header"), F.regexp_replace(F.substr(own, F.length(line) + 1), r"\s+", "").alias("sequence"))
    return rows.filter("header <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that start with one. A line that starts with ">" parts records, so large files are split among
    tasks at records, and no file is a row."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def genomes(records: DataFrame, least: int = 1000) -> DataFrame:
    """Records longer than ``least``."""
    return records.filter(F.length("sequence") > least)


def edge_sequences(records: DataFrame) -> DataFrame:
    """``label, rc_label, sequence``: two rows for each record named ``n1.e1_n2.e2``: n1.e1, and -n2.e2 reverse complemented."""
    parts = records.withColumn("a", F.substring_index("header", "_", 1)).withColumn("b", F.substr("header", F.instr("header", "_") + 1))
    other = F.concat(rc_node(F.substring_index("b", ".", 1)), F.lit("."), F.substring_index("b", ".", -1))
    made = parts.select(F.col("a").alias("x"), other.alias("y"), "sequence")
    both = F.array(F.struct(F.col("x").alias("label"), F.col("y").alias("rc_label"), "sequence"), F.struct(F.col("y").alias("label"), F.col("x").alias("rc_label"), rc_sequence("sequence").alias("sequence")))
    return made.select(F.explode(both).alias("r")).select("r.*").distinct()


def dot_edges(lines: DataFrame) -> DataFrame:
    """``src, dst, label, start_base, length, multiplicity`` of the edge lines. A line is matched once: its parts are made one
    text, which is split."""
    rows = lines.filter(F.contains("value", F.lit("[")) & F.contains("value", F.lit("->")))
    parts = F.split(F.regexp_replace("value", f"(?s){_EDGE}.*", "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    # made inside the array, the parts are made once, not again for each column
    p = rows.select(F.explode(F.array(parts)).alias("p")).filter(F.size("p") == 6)
    part = lambda i: F.get("p", F.lit(i))
    return p.select(part(0).alias("src"), part(1).alias("dst"), part(2).alias("label"), part(3).alias("start_base"), F.try_to_number(part(4), F.lit("999999999999999999")).cast("bigint").alias("length"), part(5).try_cast("double").alias("multiplicity"))


def dot_nodes(lines: DataFrame) -> DataFrame:
    """``id`` of the node lines."""
    rows = lines.filter(F.contains("value", F.lit("[")) & ~F.contains("value", F.lit("->")))
    return rows.select(F.regexp_extract("value", r'^\s*"?([^"\s\[]+)"?\s*\[', 1).alias("id")).filter("id <> '' and id not in ('node', 'edge', 'graph')")


def load_graph(spark: SparkSession, dot: str, fasta: str) -> DataFrame:
    """Edges with sequences; fails where an edge has no sequence or no listed end."""
    lines = spark.read.text(dot)
    edges = dot_edges(lines)
    met = edges.join(edge_sequences(read_fasta(spark, fasta)), "label", "left")
    if not met.filter("sequence is null").isEmpty():
        raise ValueError("an edge has no sequence")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(dot_nodes(lines), "id", "left_anti")
    if not ends.isEmpty():
        raise ValueError("an edge has an end that is not listed")
    return met


def summary(lines: DataFrame) -> DataFrame:
    """``query, ref, aligned, identity`` of alignment summary lines."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(f) >= 4).select(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("query", "ref", "aligned", "identity"))))


def summary_refs(parsed: DataFrame) -> DataFrame:
    """``query, refs``: the references of a query with their lengths and identities, in order."""
    return parsed.groupBy("query").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "ref", "aligned", "identity"))).alias("refs"))
