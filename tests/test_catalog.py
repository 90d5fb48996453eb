"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from strandweave import catalog

DIR = "/root/testdata/sf0.001"
NAMES = ("rc_sequences", "dbg_edges", "degree_table", "unitigs", "edge_labels", "bulge_collapse", "bulge_collapse_fold", "khop_paths_2", "bulge_best_pair", "safe_to_extract", "whirl_2cycle", "whirl_cycles", "tip_best_sibling", "broken_bulge_candidates", "edit_prefix_distance", "edit_infix_distance", "contracted_view", "colour_map", "interval_filtered", "walk_find_steps", "evidence_support_matrix", "evidence_accept", "unary_chain_2x2", "rc_decouple_candidates", "interval_merge", "alignment_scan", "levenshtein_pairs", "dot_export", "fasta_parse", "contains_join", "walk_find_path", "aligner_exact", "strand_round_strict", "complex_bulge_round_2", "bulge_parts", "dot_coloured")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def cell(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(str(cell(r[c])) for c in columns) for r in df.collect())
    rel = tables.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted(tuple(str(cell(r[rel.columns.index(c)])) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
