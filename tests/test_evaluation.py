"""Alignment, lineage, further metrics and graph operators against plain Python."""

import itertools
import math
import random

import plain_graphs
import pytest
from pyspark.sql import functions as F
from sparktrail.operators import alignment, graph, lineage, metrics, mutate, synth, systems, traces
from sparktrail.plans import formula as fm

MOVES = "sys string, src string, label array<string>, dst string, initial string"


def random_systems(n, seed):
    rng, out = random.Random(seed), []
    for s in range(n):
        k = rng.randint(1, 5)
        out += [(f"s{s}", f"q{rng.randrange(k)}", rng.choice([[], ["a"], ["b"]]), f"q{rng.randrange(k)}", "q0") for _ in range(rng.randint(1, 8))]
        out.append((f"s{s}", "q0", [], None, "q0"))
    return out


def test_bisimilar(spark):
    rows = random_systems(24, 5)
    df = spark.createDataFrame(rows, MOVES)
    names = sorted({r[0] for r in rows})
    pairs = [(a, b) for a, b in itertools.combinations(names, 2)] + [(n, n) for n in names]
    got = {(r.a, r.b): r.bisimilar for r in systems.bisimilar(df, spark.createDataFrame(pairs, "a string, b string")).collect()}

    def same(a, b):
        m = [(f"{t}{x[0]}{x[1]}", tuple(x[2]), f"{t}{x[0]}{x[3]}") for t, s in ((0, a), (1, b)) for x in rows if x[0] == s and x[3]]
        states = sorted({s for x in m for s in (x[0], x[2])} | {f"0{a}q0", f"1{b}q0"})
        block = plain_graphs.refine(states, m)
        return block[f"0{a}q0"] == block[f"1{b}q0"]

    assert got == {p: same(*p) for p in pairs} and all(got[n, n] for n in names) and len(set(got.values())) == 2


def test_unrolling_and_monitors(spark):
    edges = [("g", "s", False, "in", "L", True), ("g", "L", True, "body", "b", False), ("g", "b", False, "again", "L", True), ("g", "L", True, "out", "e", False)]
    df = spark.createDataFrame(edges, "graph string, src string, src_loop boolean, label string, dst string, dst_loop boolean")
    got = {(r.src, r.label, r.dst) for r in graph.unrolled(df).collect()}
    assert got == {("s", "in", "L_iter_0"), *((f"L_iter_{k}", x, y) for k in range(3) for x, y in (("body", "b"), ("out", "e"))), ("b", "again", "L_iter_1"), ("b", "again", "L_iter_2"), ("b", "again", "L_loop_exceeds_bound_error")}
    moves = graph.unrolled(df).select(F.col("graph").alias("sys"), "src", F.array("label").alias("label"), "dst", F.lit("s").alias("initial"))
    out = {r.monitor: (r.violated, r.run) for r in systems.monitored(moves, {"sees_out": systems.reachability_monitor("out"), "sees_none": systems.reachability_monitor("none"), "bound": systems.loop_bound_monitor()}).collect()}
    assert out["sees_out"] == (True, ["in", "out"]) and out["bound"] == (True, ["in", "body", "again"])
    plain = spark.createDataFrame([("s", "p", ["a"], "q", "p")], MOVES)
    assert not any(r.violated for r in systems.monitored(plain, {"none": systems.reachability_monitor("b"), "bound": systems.loop_bound_monitor()}).collect())


def test_ordering_and_collapse(spark):
    edges = spark.createDataFrame([("g", "r", "a", "r"), ("g", "a", "b", "r"), ("g", "r", "b", "r"), ("g", "b", "c", "r")], "graph string, src string, dst string, root string")
    dom = graph.dominators(edges)
    got = {(r.a, r.b): r.ordered for r in graph.ordering(dom, spark.createDataFrame([("g", "b", "c"), ("g", "a", "c"), ("g", "a", "zz")], "graph string, a string, b string")).collect()}
    assert got == {("b", "c"): True, ("a", "c"): False, ("a", "zz"): False}
    df = spark.createDataFrame([("s", "a", [], "b", "a"), ("s", "b", [], "a", "a"), ("s", "b", ["x"], "c", "a")], MOVES)
    assert [(r.src, r.label, r.dst) for r in systems.collapsed(df).collect()] == [("a", ["x"], "c")]
    both = lineage.disjoint_union(df.select("src", "label", "dst"), df.select("src", "label", "dst"))
    assert both.count() == 6 and {r.src for r in both.collect()} == {"a.a", "a.b", "b.a", "b.b"}


def test_mandatory_tasks_beyond_the_old_cap(spark):
    """15 splits make 32,768 paths; only the tasks between them are on every one."""
    nodes, edges = [("g", "s", "startEvent", "s"), ("g", "e", "endEvent", "e")], []
    before = "s"
    for k in range(15):
        nodes += [("g", f"x{k:02d}", "exclusiveGateway", None), *(("g", f"k{k:02d}{c}", "task", f"k{k:02d}{c}") for c in "ab"), ("g", f"m{k:02d}", "task", f"m{k:02d}")]
        edges += [("g", before, f"x{k:02d}"), *(("g", f"x{k:02d}", f"k{k:02d}{c}") for c in "ab"), *(("g", f"k{k:02d}{c}", f"m{k:02d}") for c in "ab")]
        before = f"m{k:02d}"
    edges.append(("g", before, "e"))
    rules = synth.properties(spark.createDataFrame(nodes, "graph string, node string, type string, name string"), spark.createDataFrame(edges, "graph string, src string, dst string"))
    p4 = {r.formula for r in rules.filter("tier = 'P4'").collect()}
    assert {f"F(done(m{k:02d}))" for k in range(15)} <= p4 and not any(f"F(done(k{k:02d}{c}))" in p4 for k in range(15) for c in "ab")


def test_alignment(spark):
    spec = spark.createDataFrame([(list("ab"),), (list("ba"),), (list("abc"),)], "trace array<string>")
    model = spark.createDataFrame([(list("ab"),), (list("abc"),), (list("x"),), (list("ab"),)], "trace array<string>")
    r = alignment.agreement(spec, model).first()
    assert (r.agreed, r.spec_only, r.model_only) == (2, 1, 1) and r.f1 == pytest.approx(2 / 3) and r.fitness == r.recall
    assert {(r.kind, "".join(r.trace)) for r in alignment.gaps(spec, model).collect()} == {("over_specification", "ba"), ("under_specification", "x")}
    assert [r.formula for r in alignment.corrections(spec, model).collect()] == ["G(b -> !F(a))"]
    rules = ["F(b)", "!b W a", "G(a -> !F(c))"]
    traces_ = alignment.rule_traces(spark, rules, list("abc"))
    got = {tuple(r.trace) for r in traces_(4).collect()}
    want = {t for k in range(1, 5) for t in itertools.product("abc", repeat=k) if all(fm.holds(fm.parse(x), [{a} for a in t]) for x in rules)}
    assert got == want
    moves = spark.createDataFrame([("p", "a", "q"), ("q", "b", "r"), ("q", "a", "q")], "src string, label string, dst string")
    runs = alignment.model_traces(moves, "p")
    assert {"".join(r.trace) for r in runs(4).collect()} == {"ab", "aab", "aaab"}
    history, ok = alignment.deepened(alignment.rule_traces(spark, ["!b W a", "F(b)", "G(b -> !X a)", "G(b -> !X b)"], ["a", "b"]), runs, 6)
    assert ok and history[-1]["f1"] == history[-2]["f1"] and alignment.certificate(history, ok, 0.5)["confidence"] == 0.999
    c = alignment.suite_coverage(spark.createDataFrame([(1, 2, 0, 0, 3, 4)], "nodes int, nodes_total int, branches int, branches_total int, depth int, bound int")).first()
    assert c.coverage == round(0.4 * 0.5 + 0.4 + 0.2 * 0.75, 4)


def test_deceptive_traces_and_healing(spark):
    nodes = spark.createDataFrame([("g", 0, "startEvent", ["s"]), ("g", 1, "task", ["start(a)", "done(a)"]), ("g", 2, "task", ["start(b)", "done(b)"]), ("g", 3, "endEvent", ["e"]), ("h", 0, "task", ["x"])], "graph string, pos int, type string, atoms array<string>")
    found = alignment.deceptive(nodes)
    assert {tuple(r.trace) for r in found.collect()} == {("s", "e"), ("done(b)", "done(a)")}
    assert {r.formula for r in alignment.forbidding(found).collect()} == {"G(s -> !F(e))", "G(done(b) -> !F(done(a)))"}
    mutants = {"m1": ["b", "a"], "m2": ["a"], "m3": ["a", "b"]}

    def audit(suite):
        rows = [(m, not all(fm.holds(fm.parse(x), [{a} for a in t]) for x in suite.values())) for m, t in mutants.items()]
        return spark.createDataFrame(rows, "mutant string, killed boolean")

    remedy = lambda alive: alive.join(spark.createDataFrame([("m1", "G(b -> !F(a))"), ("m3", None)], "mutant string, formula string"), "mutant", "left")
    suite, told = alignment.healed({"r": "F(b)"}, audit, remedy)
    assert [t["killed"] for t in told] == [1, 2] and "G(b -> !F(a))" in suite.values()
    edges = spark.createDataFrame([("g", "x", "a"), ("g", "x", "b"), ("g", "y", "a")], "graph string, src string, dst string")
    gates = spark.createDataFrame([("g", "x", "exclusiveGateway"), ("g", "y", "exclusiveGateway"), ("h", "z", "task")], "graph string, node string, type string")
    rules = spark.createDataFrame([("g", "F a")], "graph string, formula string")
    assert {(r.graph, r.splits, r.rules, r.status) for r in alignment.split_certificate(edges, gates, rules).collect()} == {("g", 1, 1, "PASS"), ("h", 0, 0, "PASS")}


def test_lineage(spark):
    bases = spark.createDataFrame([(1, "src", ["7", "loop"]), (2, "other", [])], "uid long, code string, tags array<string>")
    mutants = spark.createDataFrame([("m", 1), ("n", 9)], "mutant_id string, base_uid long")
    assert [(r.mutant_id, r.base_code) for r in lineage.with_bases(mutants, bases).collect()] == [("m", "src")]
    assert lineage.with_scores(mutants, spark.createDataFrame([("n", 0.5)], "mutant_id string, score double")).first().base_uid == 9
    assert lineage.with_corpus(spark.createDataFrame([(2, "v")], "uid long, variant string"), bases).first().code == "other"
    assert [r.t for r in bases.select(lineage.first_tag(F.col("tags")).alias("t")).collect()] == ["loop", "unknown"]
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {r.node: r.atoms for r in lineage.atoms_of(nodes, spark.createDataFrame([("a", ["x", "y"])], "node string, atoms array<string>")).collect()} == {"a": ["x", "y"], "b": ["b"]}
    old = spark.createDataFrame([("a", "b", None), ("b", "c", "x")], "src string, dst string, condition string")
    new = spark.createDataFrame([("a", "b", "y"), ("b", "c", "x")], "src string, dst string, condition string")
    assert [tuple(r) for r in lineage.changed_conditions(old, new).collect()] == [("a", "b", None, "y")]
    seen = spark.createDataFrame([("g", 2, "task", "B"), ("g", 1, "task", "A"), ("g", 3, "task", "B"), ("g", 0, "end", "Z")], "graph string, pos int, type string, name string")
    assert lineage.tasks_in_order(seen, ["task"]).first().tasks == ["A", "B"]
    results = spark.createDataFrame([("COMPLIANT", []), ("COMPLIANT", ["x"]), ("VIOLATION", [])], "verdict string, unmatched array<string>")
    assert lineage.applicable(results).count() == 1
    assert lineage.recovered(spark.createDataFrame([("g", "a"), ("g", "b"), ("g", None)], "graph string, node string"), spark.createDataFrame([("g", "a")], "graph string, node string")).first().node == "b"
    many = spark.range(100).withColumn("g", F.col("id") % 2)
    assert lineage.sample(many, "id", "s").count() == 10 and lineage.capped(many, ["g"], ["id"], 3).count() == 6
    assert spark.range(1).select(lineage.rate_cell(F.lit(98), F.lit(100), F.lit(0.9296), F.lit(0.9976)).alias("c")).first().c == "98/100 = .9800 [.9296, .9976]"
    maps = spark.range(1).select(lineage.canonical(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("a"), lineage.canonical(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1))).alias("b"), lineage.prompt_hash(F.lit("x")).alias("h")).first()
    assert maps.a == maps.b and maps.h.startswith("2d711642")


def test_further_metrics(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["buggy", "equivalent", "correct"]), round(rng.random(), 2), rng.choice("xy")) for _ in range(200)]
    df = spark.createDataFrame(rows, "class string, confidence double, operator string")
    r = metrics.three_figures(df, 0.3).first()
    share = lambda c: sum(x[1] < 0.3 for x in rows if x[0] == c) / sum(x[0] == c for x in rows)
    assert (r.detection, r.specificity, r.false_alarm) == pytest.approx((share("buggy"), 1 - share("equivalent"), share("correct"))) and r.specificity_low < r.specificity < r.specificity_high
    assert metrics.three_figures(df.limit(0), 0.3).first().detection is None
    assert {r.operator: r.n for r in metrics.flagged_by(df.filter("class = 'buggy'"), ["operator"], 0.3).collect()} == {o: sum(x[0] == "buggy" and x[2] == o for x in rows) for o in "xy"}
    d = metrics.distribution(df, [], "confidence").first()
    assert d.n == 200 and d.least == min(x[1] for x in rows) and d["mean"] == pytest.approx(sum(x[1] for x in rows) / 200) and sum(x.n for x in d.distribution) == 200
    t = {r.operator: (r.buggy, r.correct) for r in metrics.crosstab(df, ["operator"], "class", ["buggy", "correct"]).collect()}
    assert t == {o: tuple(sum(x[0] == c and x[2] == o for x in rows) for c in ("buggy", "correct")) for o in "xy"}
    pairs = spark.createDataFrame([("a", "1", "1"), ("a", "1", "2"), ("a", None, None), ("a", None, "1")], "k string, x string, y string")
    assert metrics.difference_rate(pairs, ["k"], "x", "y").first().rate == 0.5
    names = spark.createDataFrame([("g", "A", "1"), ("g", "A", "2"), ("g", "B", "3")], "graph string, name string, id string")
    assert [(r.name, r.ids) for r in metrics.duplicate_names(names, ["graph"], "name", "id").collect()] == [("A", ["1", "2"])]
    cols = "feasible int, paths int, iterations int, timeouts int, solved int, edges int, gateways int, both int"
    c = [round(r.confidence, 4) for r in metrics.search_confidence(spark.createDataFrame([(4, 4, 4, 0, 4, 4, 2, 2), (0, 4, 4, 0, 0, 4, 2, 2), (4, 4, 4, 0, 4, 4, 4, 1), (4, 4, 4, 0, 4, 1, 0, 0), (0, 0, 0, 0, 0, 0, 0, 0)], cols)).collect()]
    assert c == [1.0, 0.8, 0.8, 0.75, 0.0]
    ops = spark.createDataFrame([(1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1), (0, 0, 0, 0, 0)], "flows_lost int, retyped_gateways int, retyped_others int, conditions_changed int, atoms_changed int")
    assert [r.operator for r in metrics.mutation_operator(ops).collect()] == ["delete-flow", "swap-gateway", "retype-task", "invert-condition", "loop-boundary", "unknown"]
    res = spark.createDataFrame([("v", "VIOLATION", ["Pay it"]), ("v", "VIOLATION", ["Ship", "Pay it"]), ("v", "COMPLIANT", [])], "variant string, verdict string, atoms array<string>")
    calls = spark.createDataFrame([("v", "pay_it"), ("w", "ship")], "variant string, callee string")
    assert {r.verdict: (r.n, r.all_called, r.some_never_called) for r in metrics.verdicts_by_calls(res, calls).collect()} == {"VIOLATION": (2, 1, 1), "COMPLIANT": (1, 0, 0)}


def test_binomial_tail_by_fraction():
    for n in (1, 2, 7, 60, 400):
        for k in {0, 1, n // 3, n // 2, n}:
            for p in (0.01, 0.3, 0.5, 0.97):
                assert metrics.binomial_tail(n, k, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), abs=1e-11)
    low, high = metrics.exact_interval(50_000_000, 100_000_000)
    assert 0.4998 < low < 0.5 < high < 0.5002


def test_ranks_thresholds_and_splits(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.choice([1, 2, 2, 3, 7, 11])), rng.random(), rng.choice(["a", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, y double, s string")
    ranks = {r.id: r.r for r in metrics.average_ranks(df, "x", "r").collect()}
    values = sorted(r[1] for r in rows)
    assert all(ranks[i] == values.index(x) + (values.count(x) + 1) / 2 for i, x, _, _ in rows)
    split = traces.stratified_split(df, "id", "s", "7")
    got = {(r.s, r.calibration): r["count"] for r in split.groupBy("s", "calibration").count().collect()}
    for s in ("a", None):
        n = sum(r[3] == s for r in rows)
        assert got[s, True] == n // 2 and got[s, False] == n - n // 2
    original = spark.createDataFrame([("ab",), ("ba",)], "trace string")
    mutant = spark.createDataFrame([("same", "ab"), ("same", "ba"), ("same", "ba"), ("less", "ab"), ("more", "ab"), ("more", "ba"), ("more", "x")], "mutant string, trace string")
    assert {r.mutant for r in mutate.behaviour_changes(original, mutant).collect()} == {"less", "more"}
