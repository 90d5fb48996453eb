"""What grows with the tables: sizes of work tables, and bounds that hold exactly."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from strandweave import catalog, model
from strandweave.functions.strand import kmer_number, kmer_text, node_number, node_text
from strandweave.operators import bulge, compact, contract, degree, paths, whirl
from strandweave.plans import simplify, tables
from strandweave.sinks import export
from strandweave.sources import fixtures

DIR = "/root/testdata/sf0.001"
EDGE = "src string, dst string, sequence string, length bigint, multiplicity double"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def rows(df, columns=None):
    return sorted(tuple(map(str, r)) for r in df.select(*(columns or sorted(df.columns))).collect())


@pytest.fixture
def sizes(monkeypatch):
    """Rows of the tables written, by name."""
    out: dict[str, list[int]] = {}

    def counted(df, name):
        found = tables.written(df, name)
        out.setdefault(name, []).append(found.count())
        return found

    for m in (compact, whirl):
        monkeypatch.setattr(m, "written", counted)
    return out


def test_pointers_that_rest_are_not_written_again(spark, sizes):
    """One chain of 64 edges and 200 of three: the short ones leave after two rounds."""
    chain = lambda name, n: [(f"{name}.{i}", f"{name}.{i + 1}", "AC", 1, 1.0) for i in range(n)]
    e = spark.createDataFrame([r for j in range(200) for r in chain(f"s{j}", 3)] + chain("l", 64) + [("x", "y", "AC", 1, 1.0)], EDGE)
    got = compact.compact(e, 1)
    assert sorted(r.n_merged for r in got.collect()) == [1] + [3] * 200 + [64]
    assert sizes["chains"][0] == 463 and sizes["chains"][-1] < 64


@needs_tables
def test_kmer_graphs_by_numbers(spark):
    raw, u = catalog.raw(spark, DIR), catalog.unitigs_of(spark, DIR)
    long = model.labelled(compact.compact(raw, catalog.K).drop("n_merged"), catalog.K)
    columns = ["src", "dst", "sequence", "length", "multiplicity", "label", "rc_label", "start_base"]
    assert rows(u, columns) == rows(long, columns)
    assert rows(catalog.collapsed_of(spark, DIR), columns) == rows(model.labelled(bulge.collapse(long), catalog.K), columns)
    # the shared table holds what the rest follows from, once
    assert catalog.numbered_of(spark, DIR).columns == ["sequence", "multiplicity", "n", "beside", "rc_n", "rc_beside"]


def test_kmer_rings_are_cut_as_others(spark):
    ring = "ACCGATTGC"
    reads = spark.createDataFrame([(ring + ring[:4],), (model_rc(ring + ring[:4]),)], "s string")
    counts = fixtures.kmer_counts(reads, 3)
    got = fixtures.with_nodes(compact.compact_kmers(counts, 3), 3)
    assert rows(got) == rows(compact.compact(fixtures.with_nodes(counts, 3), 3)) and got.count() > 0


def test_kmers_are_counted_as_numbers_on_one_strand(spark):
    """Longer and shorter reads than a stretch of 31 bases, repeats, and (k+1)-mers that are their own reverse complement."""
    forward = spark.createDataFrame([("ACGT" * 20,), ("GATTACAGATTACATTTGCCCGGGAATTCCAAGTCGATCGATTTA",), ("ACGTA",), ("ACG",), (None,)], "s string")
    got = fixtures.kmer_tally(forward, 3)
    both = [(r[0],) for r in forward.collect() if r[0] and len(r[0]) > 3] + [(model_rc(r[0]),) for r in forward.collect() if r[0] and len(r[0]) > 3]
    want = fixtures.kmer_counts(spark.createDataFrame(both, "s string"), 3)
    assert rows(got.select(kmer_text("id", 4).alias("sequence"), "multiplicity")) == rows(want)
    shuffled = got._jdf.queryExecution().optimizedPlan().toString()
    assert "string" not in shuffled.split("Aggregate")[1].split("\n")[0]


def test_degrees_of_numbers(spark):
    reads = spark.createDataFrame([("AAAAACCCTTGAAAC",), (model_rc("AAAAACCCTTGAAAC"),), ("TTGACGTCAATTC",), (model_rc("TTGACGTCAATTC"),)], "s string")
    counts = fixtures.kmer_counts(reads, 3)
    got = degree.kmer_degrees(counts.select(kmer_number("sequence").alias("id"), "multiplicity"), 3)
    want = degree.degrees(fixtures.with_nodes(counts, 3))
    assert rows(got) == rows(want) and got.dtypes == want.dtypes


@needs_tables
def test_references_are_gathered_for_edges_at_sites_only(spark):
    e, sites = catalog.around_sites(spark, DIR)
    whole = catalog.lineage(spark, DIR)
    at = {r.id for r in sites.collect()}
    want = sorted((r.label, r.ref_ids) for r in whole.collect() if r.src in at or r.dst in at)
    assert sorted((r.label, r.ref_ids) for r in e.collect()) == want
    assert e.count() < whole.count()


def model_rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_degrees_take_one_shuffle(spark):
    e = spark.createDataFrame([("a", "b", "AC", 1, 2.0), ("a", "b", "AG", 1, 1.0), ("b", "b", "CC", 1, 4.0), ("b", "-a", "CT", 1, 1.0)], EDGE)
    d = degree.degrees(e)
    got = {r.id: (r.n_in, r.n_out, r.legs_in, r.legs_out, r.cov_in, r.cov_out, r.self_loops) for r in d.collect()}
    assert got == {"a": (0, 1, 0, 2, 0.0, 3.0, 0), "b": (2, 2, 3, 2, 7.0, 5.0, 1), "-a": (1, 0, 1, 0, 1.0, 0.0, 0)}
    assert d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_hops_are_walked_once(spark):
    """Paths of three edges: the second hop is read from its table, and the steps from a node take one shuffle."""
    e = spark.createDataFrame([("a", "b", "AC", 1, 2.0), ("a", "c", "AG", 1, 1.0), ("b", "d", "CC", 1, 4.0), ("c", "d", "CT", 1, 1.0), ("d", "f", "CA", 2, 1.0)], EDGE)
    e = e.withColumn("label", F.concat("src", F.lit("."), "dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = paths.khop(e, 3)
        assert sorted("".join(r.nodes) for r in found.collect()) == ["ab", "abd", "abdf", "ac", "acd", "acdf"]
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") + plan.count("BroadcastHashJoin") == 1
        one = paths.khop(e, 1)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert one.count("Exchange ") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_at_the_bound_are_pairs(spark):
    """Lengths 8 and 10 are alike by 0.8, though 1 - 0.8 isn't 0.2."""
    p = spark.createDataFrame([("A", "D", ["A", x, "D"], [f"A.{x}", f"{x}.D"], n, 1.0, 1.0) for x, n in (("B", 8), ("C", 10), ("E", 7))], "start string, end string, nodes array<string>, labels array<string>, length bigint, weight double, min_cov double")
    got = paths.bulge_pairs(p, 0.8).select("key1", "key2").collect()
    assert sorted(map(tuple, got)) == [("A.B,B.D", "A.C,C.D"), ("A.B,B.D", "A.E,E.D")]


def test_paths_without_a_reverse_have_no_row(spark):
    e = spark.createDataFrame([("a.1", "r.1"), ("b.1", None)], "label string, rc_label string")
    p = spark.createDataFrame([("x", ["a.1", "b.1"]), ("y", ["b.1"])], "key string, labels array<string>")
    assert rows(paths.reverse_labels(p, e)) == [("x", "['r.1']")]


def test_long_cycles_take_few_tables(spark, sizes):
    """A ring of 300 edges: by walks of six steps a table these were 50 tables of whole walks."""
    n = 300
    e = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % n}", f"n{i}.1", 1, float(i + 1)) for i in range(n)] + [("t", "n5", "t.1", 1, 9.0)], "src string, dst string, label string, length bigint, multiplicity double")
    got = whirl.cycles(e).collect()
    assert len(got) == n and {(r.length, r.min_cov) for r in got} == {(n, 1.0)}
    assert all(r.nodes == [f"n{(int(r.start[1:]) + j) % n}" for j in range(n + 1)] and r.labels == [f"{x}.1" for x in r.nodes[:-1]] for r in got)
    assert sum(map(len, sizes.values())) < 60 and len(sizes["whirls"]) == 1


def test_forced_whirls_meet_edges_by_equal_nodes(spark):
    """No whirl is compared with every edge; one with other edges around, one with none."""
    e = spark.createDataFrame([("a", "b", "a.1", 1, 5.0), ("b", "a", "b.1", 1, 6.0), ("x", "b", "x.1", 9, 2.0), ("a", "y", "a.2", 9, 3.0), ("a", "a", "a.3", 4, 7.0), ("y", "a", "y.1", 99, 8.0), ("c", "d", "c.1", 1, 5.0), ("d", "c", "d.1", 1, 6.0)], "src string, dst string, label string, length bigint, multiplicity double")
    found = spark.createDataFrame([("a", ["a", "b", "a"], ["a.1", "b.1"], 2, 5.0, False), ("c", ["c", "d", "c"], ["c.1", "d.1"], 2, 5.0, False), ("q", ["q", "r", "q"], ["q.1", "r.1"], 2, 1.0, True)], "start string, nodes array<string>, labels array<string>, length bigint, min_cov double, safe boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drop, reset, loops = whirl.forced(found, e)
        assert "NestedLoop" not in reset._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in reset._jdf.queryExecution().executedPlan().toString()
        assert rows(drop) == [("a.1",), ("c.1",)] and rows(reset, ["label", "multiplicity"]) == [("b.1", "2.0"), ("d.1", "None")] and loops.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_of_genomes_are_made_for_bands_of_lengths(spark):
    """Edges of 14 to 24 bases: 140 words of a genome of 64 bases, where a set of its words for each length has 506."""
    assert contract.bands(list(range(14, 25))) == [(14, 17), (18, 22), (23, 24)] and contract.bands([1, 2, 3, 24]) == [(1, 1), (2, 2), (3, 3), (24, 24)]
    rng = random.Random(3)
    genomes = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (64, 64, 90, 15, 7, 24)]
    held = [g[a : a + n] for g in genomes for n in (2, 5, 14, 15, 17, 18, 22, 23, 24, 25, 47, 64) for a in (0, len(g) - n, 3) if 0 <= a <= len(g) - n]
    e = spark.createDataFrame([(f"e{i}", x if i % 2 else model_rc(x)) for i, x in enumerate(held + ["ACGTACGTACGTACGTAAA", "", None])], "label string, sequence string")
    g = spark.createDataFrame([(f"g{i}", x) for i, x in enumerate(genomes)], "name string, sequence string")
    assert contract.places(g.filter("name = 'g0'"), contract.bands(list(range(14, 25))), 24).count() == 140
    want = sorted((r.label, f"g{i}") for r in e.collect() for i, x in enumerate(genomes) if r.sequence and (r.sequence in x or model_rc(r.sequence) in x))
    for piece in (1 << 16, 20):
        assert rows(contract.holders(e, g, piece=piece), ["label", "genome"]) == want


def test_identities_are_rounded_by_their_exact_value(spark):
    values = [k / 1000 for k in range(1001)] + [0.125, 0.375, 1.005, 7.995, 0.974999999, 0.0049999, 9.876, -0.5]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(export.two_places("v")).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]


def test_components_move_numbers_and_write_resting_pointers_once(spark, monkeypatch):
    """Nodes of k-mer graphs are numbers that sort as their names; pointers at a root leave the rounds."""
    names = ["ACG", "-ACG", "TTA", "-AAA", "CCC"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r for r in df.select("n", node_number("n", 3).alias("x"), node_text(node_number("n", 3), 3).alias("t")).collect()}
    assert all(got[n].t == n for n in names) and sorted(names) == sorted(names, key=lambda n: got[n].x)
    sizes: dict[str, list[int]] = {}

    def counted(t, name):
        out = tables.written(t, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(contract, "written", counted)
    # a way of 40 nodes whose numbers rise, 100 pairs, and nodes that meet only through roots
    links = [(i, i + 1) for i in range(1, 40)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(100)] + [(5000, 5009), (5001, 5009), (5001, 5008), (5002, 5008)]
    comps = {r.id: r.comp for r in contract.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(1, 41)} | {1000 + i: 1000 + i // 2 * 2 for i in range(200)} | {i: 5000 for i in (5000, 5001, 5002, 5008, 5009)}
    assert comps == want
    assert sizes["parents"][:3] == [141, 141, 38]


@needs_tables
def test_contracted_views_share_their_groups(spark):
    for name in ("contract_short_edges", "contracted_view", "dot_contracted"):
        catalog.queries()[name](spark, DIR).count()
    comps = catalog.groups_of(spark, DIR)
    assert comps is catalog.groups_of(spark, DIR) and comps.dtypes == [("id", "bigint"), ("comp", "bigint")]


@needs_tables
def test_paths_move_as_numbers(spark, monkeypatch):
    """Names are made when no row moves any more: work tables hold numbers, and the same paths come out."""
    seen: dict[str, list] = {}

    def kept(df, name):
        found = tables.written(df, name)
        seen.setdefault(name, []).append(found)
        return found

    monkeypatch.setattr(paths, "written", kept)
    assert catalog.queries()["khop_paths_3"](spark, DIR).count() > 0
    assert seen["paths"] and all(t in ("bigint", "double") for df in seen["paths"] for _, t in df.dtypes)
    e, s = catalog.collapsed_of(spark, DIR), catalog.steps_of(spark, DIR)
    columns = ["start", "end", "nodes", "labels", "length", "weight", "min_cov"]
    for hops in (1, 2, 3):
        assert rows(paths.named(paths.khop_numbers(s, hops, catalog.K, paths.MEASURES), catalog.K), columns) == rows(paths.khop(e, hops), columns)


@needs_tables
def test_only_paths_that_share_their_ends_are_fetched(spark):
    """Bulges are made of few of the paths, and the pairs are those of all of them; all queries about bulges share them."""
    e, s = catalog.collapsed_of(spark, DIR), catalog.steps_of(spark, DIR)
    every, few = paths.khop(e, 3), paths.sharing_ends(s, 3, catalog.K)
    columns = ["key1", "key2", "length1", "length2", "weight1", "weight2", "min_cov1", "min_cov2", "nodes1", "nodes2", "identity"]
    pairs = rows(paths.bulge_pairs(few, 0.8), columns)
    assert pairs and pairs == rows(paths.bulge_pairs(every, 0.8), columns)
    assert few.count() < every.count() and few.groupBy("start", "end").count().filter("count = 1").isEmpty()
    files = lambda name: {f.rsplit("/", 2)[-2] for f in catalog.queries()[name](spark, DIR).inputFiles()}
    assert files("bulge_pairs") == files("bulge_best_pair") == files("bulge_conflicts")


@needs_tables
def test_safety_is_kept_along_the_way(spark):
    e, s = catalog.collapsed_of(spark, DIR), catalog.steps_of(spark, DIR)
    p = paths.khop(e, 3).withColumn("key", F.array_join("labels", ","))
    bad = {r.key for r in paths.unsafe_steps(p, e, degree.degrees(e)).collect()}
    got = {",".join(r.labels): r.safe for r in paths.named(paths.safe_numbers(s, 3, catalog.K), catalog.K).collect()}
    assert bad and got == {r.key: r.key not in bad for r in p.collect()}


def test_safety_next_to_self_loops_and_single_ways(spark):
    """Numbers of 2-mers; from node 1: past 2 (a self-loop), past 3 (spent, only way in), past 4 (as 3, with coverage left)."""
    mirror = 1 << 4
    ways = [(1, 2, 5.0), (2, 2, 1.0), (2, 6, 1.0), (1, 3, 1.0), (3, 6, 2.0), (1, 4, 9.0), (4, 6, 2.0), (4, 7, 2.0)]
    s = spark.createDataFrame([(a + mirror, b + mirror, ((a + mirror) << paths.BITS) + n, None, 1, m, m) for n, (a, b, m) in enumerate(ways, 0)], "src bigint, dst bigint, step bigint, back bigint, length bigint, multiplicity double, usable double")
    got = {(r.step1 & 7, r.step2 & 7): r.safe for r in paths.safe_numbers(s, 2, 2).filter("step2 is not null").collect()}
    assert got == {(0, 2): False, (3, 4): False, (5, 6): True, (5, 7): True, **{k: v for k, v in got.items() if k[0] not in (0, 3, 5)}}


@needs_tables
def test_reverses_of_paths_are_made_from_their_nodes(spark):
    e, s = catalog.collapsed_of(spark, DIR), catalog.steps_of(spark, DIR)
    p = paths.khop(e, 2).withColumn("key", F.array_join("labels", ","))
    want = {r.key: list(r.rc_labels) for r in paths.reverse_labels(p, e).collect()}
    assert want and {",".join(r.labels): list(r.rc_labels) for r in paths.reverse_numbers(s, 2, catalog.K).collect()} == want
    # steps without a reverse complement have none, and paths of only such no row
    gone = s.withColumn("back", F.lit(None).cast("bigint"))
    assert paths.reverse_numbers(gone, 2, catalog.K).isEmpty()


@needs_tables
def test_rounds_of_bulges_take_known_pairs(spark, monkeypatch):
    """Where the pairs are known, no path is searched again, and the round is the same."""
    e, shown = catalog.collapsed_of(spark, DIR), ["src", "dst", "sequence", "length", "multiplicity"]
    want, n = simplify.complex_bulges(model.Graph(e, catalog.K), 3, 0.8, 3)
    pairs = catalog._bulges(spark, DIR, False)
    monkeypatch.setattr(paths, "khop", lambda *_: pytest.fail("searched again"))
    got, m = simplify.complex_bulges(model.Graph(e, catalog.K), 3, 0.8, 3, pairs=pairs)
    assert n == m > 0 and rows(got.edges, shown) == rows(want.edges, shown)
    assert catalog.queries()["complex_bulge_round"](spark, DIR).count() == want.edges.count()


@needs_tables
def test_evidence_moves_edges_next_to_sites_without_their_sequences(spark, monkeypatch):
    seen: dict[str, object] = {}

    def kept(df, name):
        seen[name] = tables.written(df, name)
        return seen[name]

    monkeypatch.setattr(simplify, "written", kept)
    assert catalog.queries()["evidence_decoupled"](spark, DIR).count() > 0
    assert "sequence" not in seen["evidence"].columns
    assert seen["evidence"].count() == seen["around"].count() < catalog.unitigs_of(spark, DIR).count()
