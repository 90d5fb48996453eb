"""Operators on small graphs with hand-computed results, and properties of the graph."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandweave import model, motifs
from strandweave.operators import bulge, contract, coverage, decouple, degree, intervals, paths, tips, walk, whirl
from strandweave.operators.compact import compact
from strandweave.plans import simplify
from strandweave.sinks import export
from strandweave.sources import text

K = motifs.K


def graph(spark, name):
    return model.Graph(model.labelled(motifs.edges(spark, name), K), K)


def covs(edges):
    return {(r.src, r.dst): r.multiplicity for r in edges.collect()}


@pytest.mark.parametrize("name", [n for n in motifs.MOTIFS if n != "broken"])
def test_motifs_hold_the_checks(spark, name):
    assert {r.check: r.n for r in model.violations(graph(spark, name)).collect()} | {"palindrome": 0} == dict.fromkeys(("strand symmetry", "length", "palindrome", "label"), 0)


def test_simple_bulge(spark):
    got = bulge.collapse(motifs.edges(spark, "simple_bulge")).filter("src = 'A'").first()
    assert (got.length, got.multiplicity) == (10, 8.0)
    assert bulge.collapse(motifs.edges(spark, "rc_bulge")).count() == motifs.edges(spark, "rc_bulge").count()
    assert bulge.collapse(motifs.edges(spark, "rc_bulge"), skip_rc=False).count() < motifs.edges(spark, "rc_bulge").count()


def test_collapse_keeps_the_sum_of_coverage(spark):
    e = motifs.edges(spark, "simple_bulge")
    total = lambda d: d.agg(F.sum("multiplicity")).first()[0]
    assert total(e) == total(bulge.collapse(e)) == total(bulge.fold(e))


def test_fold_tie_keeps_the_first(spark):
    e = spark.createDataFrame([("A", "B", 10, 5.0, "AA"), ("A", "B", 9, 3.0, "AC"), ("A", "B", 10, 6.0, "AG")], "src string, dst string, length bigint, multiplicity double, sequence string")
    assert bulge.fold(e).first().sequence == "AA" and bulge.collapse(e).first().sequence == "AG"


def test_complex_bulges(spark):
    both, n = simplify.complex_bulges(graph(spark, "complex_both"), 3, 0.8, 3)
    assert n and covs(both.edges)[("A", "D")] == 7.0
    one, n = simplify.complex_bulges(graph(spark, "complex_one"), 3, 0.8, 2)
    assert n and ("A", "B") not in covs(one.edges)
    assert simplify.complex_bulges(graph(spark, "complex_none"), 3, 0.8, 2)[1] == 0


def test_whirls(spark):
    g = graph(spark, "whirl_safe")
    found = {(r.start, r.safe): r.min_cov for r in whirl.classified(whirl.cycles(g.edges), g.edges).collect()}
    assert found[("A", True)] == 3.0
    out, n = simplify.whirls(g)
    assert n and covs(out.edges)[("A", "A")] == 3.0 and ("A", "B") not in covs(out.edges)
    unsafe = graph(spark, "whirl_unsafe")
    assert simplify.whirls(unsafe)[1] == 0
    assert simplify.whirls(unsafe, force=True)[1] > 0


def test_compaction_of_chain_and_cycle(spark):
    rows = [("a", "b", "ACGTA", 2, 4.0), ("b", "c", "GTACC", 2, 2.0), ("c", "d", "ACCGG", 2, 3.0)]
    e = spark.createDataFrame(rows, "src string, dst string, sequence string, length bigint, multiplicity double")
    got = compact(e, 3).collect()
    assert [(r.src, r.dst, r.sequence, r.length, r.multiplicity, r.n_merged) for r in got] == [("a", "d", "ACGTACCGG", 6, 3.0, 3)]
    ring = compact(motifs.edges(spark, "cycle"), K).collect()
    assert len(ring) == 2 and all(r.src == r.dst and r.n_merged == 3 for r in ring)
    assert compact(motifs.edges(spark, "loop_only"), K).count() == 2


def test_coverage_thresholds(spark):
    rows = [("a", "b", 9999, 10.0), ("b", "c", 10000, 10.5), ("c", "d", 9999, 14.0), ("d", "e", 10000, 14.0), ("e", "f", 5, 15.0)]
    e = spark.createDataFrame([(*r, "A") for r in rows], "src string, dst string, length bigint, multiplicity double, sequence string")
    assert {r.src for r in coverage.low_coverage(e, 15.0).collect()} == {"a", "c"}
    assert coverage.without_low_coverage(motifs.edges(spark, "loop_only"), 15.0).count() == 0


def test_broken_bulge(spark):
    g = graph(spark, "broken")
    assert {(r.src, r.dst) for r in tips.broken_bulges(g.edges).collect()} == {("U", "V"), ("-V", "-U")}
    assert simplify.broken_bulges(g)[1] == 1


def test_strands(spark):
    g = graph(spark, "strands")
    sites = decouple.strand_sites(g.edges, decouple.unary_chains(g.edges)).collect()
    assert {(s.head, s.tail) for s in sites} >= {("M", "N")}
    assert decouple.strand_sites(g.edges, decouple.unary_chains(g.edges), strict=True).count() == 0


def test_evidence(spark):
    rows = [("P", "M", "p", 5.0, ["r1"]), ("Q", "M", "q", 4.0, ["r2"]), ("M", "X", "x", 5.0, ["r1"]), ("M", "Y", "y", 4.0, ["r2"])]
    e = spark.createDataFrame(rows, "src string, dst string, label string, multiplicity double, ref_ids array<string>").withColumn("length", F.lit(5))
    m = decouple.support(e, spark.createDataFrame([("M",)], "id string"))
    got = decouple.accepted(m).first()
    assert (got.in1, got.out1, got.in2, got.out2, got.crossed) == ("p", "x", "q", "y", False)
    assert {(r.in_label, r.out_label): r.coverage for r in decouple.greedy_matching(m).collect()} == {("p", "x"): 5.0, ("q", "y"): 4.0}
    contrary = e.withColumn("ref_ids", F.array(F.lit("r1")))
    assert decouple.accepted(decouple.support(contrary, spark.createDataFrame([("M",)], "id string"))).count() == 0


def shared_refs(edges):
    """r1 on the edges of P and X, r2 on those of Q and Y, both on a middle edge."""
    ends = F.concat_ws(",", "src", "dst")
    one, two = ends.rlike("[PX]"), ends.rlike("[QY]")
    refs = F.when(one, F.array(F.lit("r1"))).when(two, F.array(F.lit("r2"))).when(ends.rlike("M.*N|N.*M"), F.array(F.lit("r1"), F.lit("r2"))).otherwise(F.array().cast("array<string>"))
    return edges.select(F.col("label").alias("query"), F.explode(refs).alias("ref"))


@pytest.mark.parametrize("name", ["site_node", "site_edge"])
def test_evidence_parts_ways(spark, name):
    g = graph(spark, name)
    out, n = simplify.evidence(g, shared_refs)
    top = 6.0 if name == "site_edge" else 5.0
    assert n == 1 and covs(out.edges) == pytest.approx({("P", "X"): top, ("-X", "-P"): top, ("Q", "Y"): 4.0, ("-Y", "-Q"): 4.0})
    assert {r.check: r.n for r in model.violations(out).collect()} == dict.fromkeys(("strand symmetry", "length", "palindrome", "label"), 0)
    assert simplify.evidence(out, shared_refs)[1] == 0
    assert simplify.evidence(g, lambda e: e.select(F.col("label").alias("query"), F.lit("r").alias("ref")))[1] == 0
    assert simplify.evidence(g, lambda e: shared_refs(e).limit(0))[1] == 0


def test_evidence_of_many_ways_keeps_the_rest(spark):
    g = graph(spark, "site_many")
    assert simplify.evidence(g, shared_refs)[1] == 0
    out, n = simplify.evidence(g, shared_refs, many=True)
    assert n == 1 and {(k): v for k, v in covs(out.edges).items() if not k[0].startswith("-")} == pytest.approx({("P", "X"): 6.0, ("Q", "Y"): 4.0, ("R", "M"): 2.0})


def test_intervals_against_the_sequential_rule(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randint(1, 3), "r", (a := rng.randint(0, 3_000_000)), a + (n := rng.randint(1, 300_000)), n, rng.randint(90, 100) / 100) for _ in range(300)]
    got = intervals.merge(spark.createDataFrame(rows, "query int, ref_id string, ref_start bigint, ref_end bigint, length bigint, identity double")).collect()
    want = []
    for q in (1, 2, 3):
        held = None
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], -r[3], -r[5], r[4])):
            if held and r[3] <= held[1]:
                continue
            if held and r[2] < held[1] + intervals.GAP:
                held = [held[0], r[3], held[2] + r[4], held[3] + r[4] * r[5]]
                want[-1] = (q, *held)
            else:
                held = [r[2], r[3], r[4], r[4] * r[5]]
                want.append((q, *held))
    assert sorted((r["query"], r.ref_start, r.ref_end, r.length) for r in got) == sorted(w[:4] for w in want)
    assert sorted(round(r.identity, 9) for r in got) == sorted(round(w[4] / w[3], 9) for w in want)


def test_intervals_of_a_hot_query_are_merged_by_ranges(spark):
    rng = random.Random(14)
    rows = [("hot" if rng.random() < 0.8 else f"q{rng.randrange(5)}", f"r{rng.randrange(2)}", a := rng.randrange(10**7), a + rng.randrange(1, 60_000), rng.randrange(1, 900), rng.random()) for _ in range(900)]
    rows += rows[:40] + [("hot", "r0", 5, 9_000_000, 7, 0.5)]  # one interval reaches over most ranges
    df = spark.createDataFrame(rows, "query string, ref_id string, ref_start bigint, ref_end bigint, length bigint, identity double")
    show = lambda d: sorted((r["query"], r.ref_id, r.ref_start, r.ref_end, r.length, round(r.identity, 9)) for r in d.collect())
    for d in (df, df.filter("length <> 7")):
        want = show(intervals.merge(d, gap=3000))
        assert show(intervals.merge(d, gap=3000, hot=50)) == want and len(want) > 5
    assert intervals.merge(df.limit(0), hot=0).count() == 0


def test_walks(spark):
    w = spark.createDataFrame([(1, i, n) for i, n in enumerate("abcabc")], "walk int, pos int, node string")
    assert {(r.src, r.dst): r.positions for r in walk.edge_orders(w).collect()}[("a", "b")] == "1:0,1:3"
    assert sorted(r.pos for r in walk.find_path(w, ["a", "b", "c"]).collect()) == [0, 3]


def test_long_walks_are_cut_into_blocks(spark):
    rng = random.Random(19)
    walks = {1: [rng.choice("ab") for _ in range(700)], 2: list("abc"), 3: list("aaaaaaa")}
    w = spark.createDataFrame([(k, 2 * i, n) for k, nodes in walks.items() for i, n in enumerate(nodes)], "walk int, pos int, node string")
    for path in (list("aba"), list("aa"), ["b"]):
        every = {(k, 2 * i) for k, nodes in walks.items() for i in range(len(nodes) - len(path) + 1) if nodes[i : i + len(path)] == path}
        kept, step = set(), max(len(path) - 1, 1)
        for k, nodes in walks.items():
            i = 0
            while i <= len(nodes) - len(path):
                if nodes[i : i + len(path)] == path:
                    kept.add((k, 2 * i))
                    i += step
                else:
                    i += 1
        for hot in (0, 10**6):
            assert {tuple(r) for r in walk.find_path(w, path, hot=hot, block=9).collect()} == every
            assert {tuple(r) for r in walk.find_path(w, path, True, hot=hot, block=9).collect()} == kept
    assert walk.steps(w, 0, 5).count() == 707 and {tuple(r) for r in walk.steps(w, 0, 5).collect()} == {tuple(r) for r in walk.steps(w).collect()}


def test_contraction(spark):
    e = motifs.edges(spark, "complex_both")
    got = contract.contracted_nodes(e, 100).collect()
    assert sorted(r.n_edges for r in got) == [6, 6]
    assert contract.contracted_edges(e, 100).count() == 0 and contract.contracted_edges(e, 1).count() == e.count()
    empty = contract.components(spark.createDataFrame([], "a string, b string"))
    assert empty.count() == 0


def test_views_as_files(spark, tmp_path):
    g = graph(spark, "complex_both")
    edges = g.edges.withColumn("ref_ids", F.when(F.col("src") == "A", F.array(F.lit("-2B 9"), F.lit("x"))))
    export.write_view(edges, str(tmp_path / "c"), 100)
    assert {r.value for r in spark.read.text(str(tmp_path / "c/dot")).collect()} == {'"A_Y_N6_L30" [style=filled fillcolor="white"]', '"-A_-Y_N6_L30" [style=filled fillcolor="white"]'}
    export.write_view(edges, str(tmp_path / "d"), coloured=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "d/dot")).collect() if "->" in r.value]
    assert len(lines) == 12 and sum("#628DCF" in x and "\\n-2B 9\\nx" in x for x in lines) == 2 and sum('color="black"' in x for x in lines) == 10
    with pytest.raises(Exception, match="exist"):
        export.write_view(edges, str(tmp_path / "d"))


def test_files_round_trip(spark, tmp_path):
    g = graph(spark, "complex_both")
    export.write_graph(g.edges, str(tmp_path / "g"))
    back = text.load_graph(spark, str(tmp_path / "g/dot"), str(tmp_path / "g/fasta"))
    want = {(r.src, r.dst, r.label, r.length, r.multiplicity, r.sequence) for r in g.edges.collect()}
    assert {(r.src, r.dst, r.label, r.length, r.multiplicity, r.sequence) for r in back.collect()} == want
    with pytest.raises(Exception, match="exist"):
        export.write_graph(g.edges, str(tmp_path / "g"))


def test_command_line(spark, tmp_path):
    from strandweave.__main__ import main, options

    g = graph(spark, "site_node")
    export.write_graph(g.edges, str(tmp_path / "g"))
    shared_refs(g.edges).selectExpr("concat_ws('\t', query, ref, '9(0-9)', '0.99') as value").write.text(str(tmp_path / "aln"))
    files = ["--dot", str(tmp_path / "g/dot"), f"--fasta={tmp_path / 'g/fasta'}"]
    main([*files, "-o", str(tmp_path / "out"), "-a", str(tmp_path / "aln"), "--stages", "simple_bulges", "evidence_1"])
    got = text.load_graph(spark, str(tmp_path / "out/dot"), str(tmp_path / "out/fasta"))
    assert set(covs(got)) == {("P", "X"), ("-X", "-P"), ("Q", "Y"), ("-Y", "-Q")}
    for wrong in (["--hops", "1", "2", "3", "11"], ["--stages", "none"], ["--floor", "x"]):
        with pytest.raises(SystemExit):
            options().parse_args([*files, "-o", "x", *wrong])
    with pytest.raises(SystemExit):
        main(["-o", "x"])
    main([*files, "-o", str(tmp_path / "one"), "-a", str(tmp_path / "aln"), "--stages", "simple_bulges", "evidence_1", "--snapshots", str(tmp_path / "snap")])
    main(["--restart", str(tmp_path / "snap/01-simple_bulges"), "-o", str(tmp_path / "two"), "-a", str(tmp_path / "aln"), "--after", "complex_5", "--stages", "evidence_1"])
    one, two = (text.load_graph(spark, str(tmp_path / f"{d}/dot"), str(tmp_path / f"{d}/fasta")) for d in ("one", "two"))
    assert covs(one) == covs(two) == covs(got)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "two/path")).collect())
    assert any("->(" in x for x in lines) and sum(x.startswith(">") for x in lines) == 2


def rebuilt(before, after):
    """Whether each edge's sequence is that of its way through the original edges."""
    original = {r.label: (r.src, r.dst, r.sequence) for r in before.collect()}
    for r in after.collect():
        parts = [original[x] for x in r.path_edges]
        sequence = parts[0][2] + "".join(q[K:] for _, _, q in parts[1:])
        if sequence != r.sequence or r.path_nodes != [parts[0][0], *(v for _, v, _ in parts)] or (r.path_nodes[0], r.path_nodes[-1]) != (r.src, r.dst):
            return False
    return True


# u -> n -> v with a loop at n; a loop with one way out; a loop with one way in
LOOPS = {
    "loop_between": ([("A", "N", 6, 4.0), ("N", "N", 5, 8.2), ("N", "B", 6, 4.0)], ("A", "B"), 6 + 2 * 5 + 6, 4.0),
    "loop_out": ([("N", "N", 5, 9.0), ("N", "B", 6, 3.0), ("B", "C", 6, 3.0), ("B", "D", 6, 3.0), ("E", "B", 5, 2.0)], ("N", "B"), 3 * 5 + 6, 3.0),
    "loop_in": ([("A", "N", 6, 3.0), ("N", "N", 5, 3.2), ("C", "A", 6, 3.0), ("D", "A", 6, 3.0), ("A", "E", 5, 2.0)], ("A", "N"), 6 + 5, 3.0),
}


@pytest.mark.parametrize("name", LOOPS)
def test_self_loops_are_unrolled(spark, monkeypatch, name):
    rows, ends, length, coverage_ = LOOPS[name]
    monkeypatch.setitem(motifs.MOTIFS, name, rows)
    g = model.Graph(model.with_lineage(graph(spark, name).edges), K)
    out, n = simplify.fixpoint(g, simplify.unrolled)
    got = {(r.src, r.dst): (r.length, r.multiplicity) for r in out.edges.collect()}
    assert n == 1 and got[ends] == (length, coverage_) and not any(u == v for u, v in got)
    mirror = tuple(motifs.rc(x) for x in reversed(ends))
    assert got[mirror] == got[ends]
    assert {r.check: r.n for r in model.violations(out).collect()} == dict.fromkeys(("strand symmetry", "length", "palindrome", "label", "lineage"), 0)
    assert rebuilt(g.edges, out.edges)
    assert simplify.unrolled(graph(spark, "loop_only"))[1] == 0


@pytest.mark.parametrize("name", ["complex_both", "whirl_safe", "strands", "simple_bulge", "site_edge"])
def test_edges_keep_their_way_through_the_original_graph(spark, name):
    g = graph(spark, name)
    plan = simplify.stages(floor=0.0, least=(0.0, 0.0), hops=(2, 3, 3, 4), aligned=shared_refs)
    some = [s for s in plan if s.name in ("simple_bulges", "whirls", "complex_3.1", "evidence_1", "strands")]
    out = simplify.simplify(g, some)
    assert rebuilt(g.edges, out.edges) and {r.n for r in model.violations(out).collect()} == {0}
    lines = [r.value for r in export.path_lines(out.edges).collect()]
    assert len(lines) == out.edges.filter("label <= rc_label").count() and all(x.count("->(") >= 1 for x in lines)


def test_whole_plan_on_a_small_graph(spark):
    g = graph(spark, "complex_both")
    seen = []
    out = simplify.simplify(g, simplify.stages(floor=0.0, least=(0.0, 0.0), hops=(2, 3, 3, 4)), lambda name, _, n: seen.append(name))
    assert len(seen) == len(set(seen)) == 27 and rebuilt(g.edges, out.edges)


def test_tips_fold_into_the_longest(spark, monkeypatch):
    monkeypatch.setitem(motifs.MOTIFS, "two_tips", [("X", "A", 9, 5.0), ("Y", "A", 9, 5.0), ("A", "S", 30, 4.0), ("A", "T", 29, 2.0)])
    g = graph(spark, "two_tips")
    pairs = tips.similarities(tips.tip_groups(g.edges).select("src", F.col("keep").alias("edge"), "tip", "keep_length", "tip_length"), g.edges, K)
    assert {(r.src, r.keep_length, r.tip_length): r.similarity >= 0.8 for r in pairs.collect()} == {("A", 30, 29): True, ("-A", 9, 9): False}
    out, n = simplify.tips_into_tips(g)
    assert n == 1 and covs(out.edges)["A", "S"] == covs(out.edges)["-S", "-A"] == 6.0 and ("A", "T") not in covs(out.edges)


def test_palindromic_bulges_split(spark, monkeypatch):
    monkeypatch.setitem(motifs.MOTIFS, "palindrome", [("A", "B", 5, 3.0), ("B", "-A", 6, 3.0), ("A", "C", 5, 2.0), ("C", "-A", 7, 2.0), ("X", "A", 9, 9.0), ("B", "Z", 5, 1.0), ("C", "W", 5, 1.0)])
    g = graph(spark, "palindrome")
    out, n = simplify.palindromic_split(g, 2)
    found = out.edges.filter("src = 'A' and dst = '-A'").collect()
    assert n == 1 and len(found) >= 2 and {r.length for r in found} == {11, 12}


def test_aligned_identity_and_steps_of_the_other_strand(spark):
    e = graph(spark, "complex_both").edges
    found = paths.khop(e, 3)
    by_length = paths.bulge_pairs(found, 0.5).filter("start = 'A' and end = 'D'").first()
    by_columns = paths.bulge_pairs(found, 0.5, edges=e, k=K).filter("start = 'A' and end = 'D'").first()
    assert by_length.identity == 1.0 and 0.5 <= by_columns.identity <= 1.0
    rows = [("s", "t", ["s", "a", "-t", "t"], ["1", "2", "3"]), ("s", "t", ["s", "b", "c", "t"], ["4", "5", "6"]), ("s", "t", ["s", "-c", "-b", "t"], ["7", "8", "9"])]
    p = spark.createDataFrame([(*r, 9, 1.0, 1.0) for r in rows], "start string, end string, nodes array<string>, labels array<string>, length bigint, weight double, min_cov double")
    pairs = {(r.key1, r.key2) for r in paths.bulge_pairs(p, 0.5, True).collect()}
    assert pairs == {("1,2,3", "4,5,6"), ("1,2,3", "7,8,9")}  # b -> c and -c -> -b are one step


def test_parts_with_two_ways_in_and_out(spark):
    bulges = spark.createDataFrame([("s", "t", "k1", "k2", ["s", "a", "b", "c", "t"], ["s", "t"])], "start string, end string, key1 string, key2 string, nodes1 array<string>, nodes2 array<string>")
    deg = spark.createDataFrame([("a", 2, 1, 0), ("b", 1, 2, 0), ("c", 1, 2, 0)], "id string, n_in bigint, n_out bigint, self_loops bigint")
    r = paths.with_parts(bulges, deg).first()
    assert r.parts1 == [["s", "a", "b", "c"], ["s", "a", "b", "c", "t"]] and r.parts2 == []


def test_search_goes_on_at_the_last_node_of_a_match(spark):
    w = spark.createDataFrame([(1, i, n) for i, n in enumerate("aaaaa")] + [(2, i, n) for i, n in enumerate("abaab")], "walk int, pos int, node string")
    pick = lambda path, resume: sorted((r.walk, r.pos) for r in walk.find_path(w, path, resume).collect())
    assert pick(["a", "a", "a"], False) == [(1, 0), (1, 1), (1, 2)] and pick(["a", "a", "a"], True) == [(1, 0), (1, 2)]
    assert pick(["a", "b"], True) == [(2, 0), (2, 3)] and pick(["a"], True) == pick(["a"], False)


def test_holders_across_pieces_and_repeats(spark):
    import random

    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genome = made(700)
    genomes = [("one", genome), ("two", "ACG" * 100), ("three", made(300) + genome[100:160])]
    edges = [(f"e{k}", genome[a : a + n]) for k, (a, n) in enumerate([(0, 700), (10, 24), (45, 200), (600, 100), (3, 25), (300, 7), (110, 47)])]
    edges += [("rc", motifs.rc_sequence(genome[200:330])), ("no", genome[200:330] + "A" + genome[330:390]), ("repeat", "ACG" * 30), ("gap", "ACG" * 15 + "T" + "ACG" * 15), ("all", "GT")]
    e, g = spark.createDataFrame(edges, "label string, sequence string"), spark.createDataFrame(genomes, "name string, sequence string")
    want = {(label, name) for label, q in edges for name, t in genomes if q in t or motifs.rc_sequence(q) in t}
    for piece in (40, 1 << 16):
        assert {(r.label, r.genome) for r in contract.holders(e, g, piece=piece).collect()} == want


def test_fasta_files_are_read_by_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACG\nTT\n\n>two\r\nGG\r\nCC\r\n>three\n")
    (tmp_path / "b.fa").write_text("\n>four\nA\n>five\nC>C\n")
    got = {(r.header, r.sequence) for r in text.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("one x", "ACGTT"), ("two", "GGCC"), ("three", ""), ("four", "A"), ("five", "C>C")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = [(f"r{k}", "ACGT" * (k % 9)) for k in range(200)]
        (tmp_path / "c.txt").write_text("".join(f">{h}\n{q}\n" for h, q in rows))
        assert sorted((r.header, r.sequence) for r in text.read_fasta(spark, str(tmp_path / "c.txt")).collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_colours(spark):
    refs = spark.createDataFrame([("1A",), ("-22P",), ("26B",), ("24M",), ("Y",), ("--X",), (None,)], "ref string")
    assert [r.c for r in refs.select(contract.colour("ref").alias("c")).collect()] == ["#325527", "#5AB499", "#969696", "", "#969696", "", ""]
    assert len(contract.COLOURS) == 26 * 2 + 23 * 2 + 2
    own = spark.createDataFrame([("1A", "red"), ("1A", "red")], "name string, colour string")
    assert sorted(r.colour for r in contract.coloured_by(refs, own).collect()) == [""] * 6 + ["red"]


def test_tables_made_once_follow_their_files(spark, tmp_path):
    from strandweave.plans import tables

    path = str(tmp_path / "t")
    read = lambda: tables.once(spark, ("test", path), lambda: spark.read.parquet(path), path).count()
    spark.range(3).write.parquet(path)
    assert read() == read() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert read() == 5


def test_malformed_lines_are_skipped(spark):
    lines = spark.createDataFrame([("x",), ('"A" -> "B" [label="A.1 C 5(2.5)" color="black"]',), (None,), ("",), ('"A" [style=filled]',)], "value string")
    assert [tuple(r) for r in text.dot_edges(lines).collect()] == [("A", "B", "A.1", "C", 5, 2.5)]
    assert [r.id for r in text.dot_nodes(lines).collect()] == ["A"]
    assert text.summary(spark.createDataFrame([("a b c",), ("a b c d",)], "value string")).count() == 1


def random_graph(spark, rng, nodes, count):
    rows = set()
    for _ in range(count):
        u, v = (f"{rng.choice(('', '-'))}n{rng.randrange(nodes)}" for _ in range(2))
        rows |= {(u, v), (motifs.rc(v), motifs.rc(u))}
    made = [(u, v, 4 + len(u + v) % 3, 1.0 + (len(u) * 7 + len(v)) % 5, f"{u}>{v}") for u, v in sorted(rows)]
    return spark.createDataFrame(made, "src string, dst string, length bigint, multiplicity double, label string")


def test_search_from_both_ends_finds_the_same_pairs(spark):
    rng = random.Random(17)
    some = 0
    for allow_rc in (False, True):
        e = random_graph(spark, rng, 12, 18)
        show = lambda p: {(r.key1, r.key2, r.length1, r.length2, r.min_cov1, r.min_cov2, round(r.weight1, 6)) for r in paths.bulge_pairs(p, 0.0, allow_rc).collect()}
        want = show(paths.khop(e, 7, allow_rc))
        assert show(paths.two_ended(e, 7, allow_rc)) == want
        some += len(want)
    assert some > 20


def test_search_from_both_ends_walks_no_dead_ends(spark):
    """A node from which all ways part, each step in three, and two of them meet again after eight steps."""
    rows, level = [], ["r"]
    for depth in range(4):
        below = [f"{n}{c}" for n in level for c in "abc"]
        rows += [(n[:-1], n) for n in below]
        level = below
    chain = lambda a, z, name: [(x, y) for x, y in zip([a, *(f"{name}{i}" for i in range(3))], [*(f"{name}{i}" for i in range(3)), z])]
    rows += chain(level[0], "end", "x") + chain(level[-1], "end", "y")
    e = spark.createDataFrame([(u, v, 5, 2.0, f"{u}>{v}") for u, v in rows], "src string, dst string, length bigint, multiplicity double, label string")
    forward, backward, first = paths.halves(e, 10)
    assert first == 5 and forward.count() <= 40 and backward.count() <= 10 and paths.khop(e, 10).count() > 300
    (pair,) = paths.bulge_pairs(paths.two_ended(e, 10), 0.0).collect()
    assert (pair.start, pair.end, pair.n_edges) == ("r", "end", 16)


def test_committed_candidates_are_those_of_a_pass_in_order(spark):
    import random

    rng = random.Random(12)
    for nodes, count in ((200, 60), (25, 40), (8, 30)):
        rows = [(f"k{i:03d}", [f"{rng.choice(('', '-'))}{rng.randrange(nodes)}" for _ in range(rng.randint(1, 4))], rng.randrange(5)) for i in range(count)]
        rows += [(f"p{i:03d}", [f"n{i}", f"n{i + 1}"], 9) for i in range(12)]  # rivals in a row
        used, want = set(), set()
        for _, key, footprint in sorted((p, k, f) for k, f, p in rows):
            mine = {x.lstrip("-") for x in footprint}
            if not mine & used:
                used |= mine
                want.add(key)
        df = spark.createDataFrame(rows, "key string, footprint array<string>, p int")
        assert {r.key for r in simplify.independent(df, "footprint", [F.col("p")]).collect()} == want
    assert simplify.independent(df.limit(0), "footprint", [F.col("p")]).count() == 0


def test_fixpoint_ends_or_fails():
    assert simplify.fixpoint(model.Graph(None, 3), lambda g: (g, 0))[1] == 0
    with pytest.raises(RuntimeError):
        simplify.fixpoint(model.Graph(None, 3), lambda g: (g, 1), cap=3)


def test_empty_graph(spark):
    e = motifs.edges(spark, "cycle").limit(0)
    assert degree.degrees(e).count() == bulge.collapse(e).count() == compact(e, K).count() == 0
    assert paths.khop(model.labelled(e, K), 3).count() == 0


def test_streaming_coverage(spark, tmp_path):
    from strandweave.streaming.coverage import edge_coverage

    spark.createDataFrame([("ACGTACGTACGTACGTA",)], "s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string").parquet(str(tmp_path / "in"))
    q = edge_coverage(stream).writeStream.outputMode("complete").format("memory").queryName("cov").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("cov").agg(F.sum("multiplicity")).first()[0] == 4.0


def test_holders_of_short_edges(spark):
    e = spark.createDataFrame([("a", "ACGTTC"), ("b", "GAACGT"), ("c", "GGGGG"), ("d", "ACGTTCA" * 5), ("e", "")], "label string, sequence string")
    g = spark.createDataFrame([("one", "TT" + "ACGTTCA" * 5), ("two", "CCCCC"), ("three", "A")], "name string, sequence string")
    got = {(r.label, r.genome) for r in contract.holders(e, g).collect()}
    assert got == {("a", "one"), ("b", "one"), ("c", "two"), ("d", "one")}


def test_long_whirls_and_chains(spark, monkeypatch):
    ring = "ABCDEFGHIJ"
    monkeypatch.setitem(motifs.MOTIFS, "long_whirl", [(u, v, 5, 3.0) for u, v in zip(ring, ring[1:] + "A")] + [("A", "Z", 5, 7.0)])
    found = whirl.cycles(graph(spark, "long_whirl").edges)
    assert [len(r.labels) for r in found.filter("start = 'A'").collect()] == [10]
    inner = "Mabcdefghijklm" + "N"  # 14 edges
    monkeypatch.setitem(motifs.MOTIFS, "long_chain", [("P", "M", 6, 5.0), ("Q", "M", 6, 4.0), *((u, v, 6, 9.0) for u, v in zip(inner, inner[1:])), ("N", "-P", 6, 5.0), ("N", "R", 6, 4.0)])
    g = graph(spark, "long_chain")
    chains = {(r.head, r.tail): r.nodes for r in decouple.unary_chains(g.edges).collect()}
    assert chains["M", "N"] == list(inner)
    out, n = simplify.fixpoint(g, simplify.strands)
    assert n and {("P", "R"), ("Q", "-P")} <= {(r.src, r.dst) for r in out.edges.collect()}
    assert {r.length for r in out.edges.filter("src = 'P' and dst = 'R'").collect()} == {16 * 6}


@pytest.mark.parametrize("seed", [0, 3, 5])
def test_whirls_of_random_successors(spark, seed):
    rng = random.Random(seed)
    nodes = [str(i) for i in range(60)]
    rows = [(n, rng.choice(nodes), 1, float(rng.randint(1, 9))) for n in nodes for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 1, 2)))]
    rows = [(*r, f"e{i}") for i, r in enumerate(rows)]
    leave = {n: [r for r in rows if r[0] == n] for n in nodes}
    want = set()
    for r in rows:
        way = [r]
        while r[0] != r[1] and len(way) <= len(nodes) and way[-1][1] != r[0] and len(leave[way[-1][1]]) == 1 and leave[way[-1][1]][0][1] != way[-1][1]:
            way.append(leave[way[-1][1]][0])
        if r[0] != r[1] and way[-1][1] == r[0]:
            want.add((r[0], tuple(x[4] for x in way), len(way), min(x[3] for x in way)))
    e = spark.createDataFrame(rows, "src string, dst string, length bigint, multiplicity double, label string")
    got = {(r.start, tuple(r.labels), r.length, r.min_cov) for r in whirl.cycles(e).collect()}
    assert got == want and (want or seed == 3)
    assert {(r.start, tuple(r.labels)) for r in whirl.cycles(e, 3).collect()} == {w[:2] for w in want if w[2] <= 3}


def test_a_line_of_a_dot_file_is_matched_once(spark):
    lines = spark.createDataFrame([('"A" -> "-B" [label="A.1 C 5(2.5)" color="black"]',), ('"A" -> [label="x"]',), ('  "A" -> "B" [label="q" x]',), ('"a -> b" [',), (None,)], "value string")
    got = text.dot_edges(lines)
    assert [tuple(r) for r in got.collect()] == [("A", "-B", "A.1", "C", 5, 2.5)]
    assert got._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1
