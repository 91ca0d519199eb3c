import itertools
import random

import plain_graphs
import pytest
from pyspark.sql import functions as F
from sparktrail.functions import graphs, text
from sparktrail.operators import gates, graph, match, metrics, mutate, synth, systems, traces
from sparktrail.sources import bpmn, programs, tables

LETTERS = "abcd"


def moves(spec, sys="s", initial="p"):
    """'p -a-> q, q --> r' as rows."""
    out = []
    for part in spec.split(","):
        a, label, b = part.split()
        out.append((sys, a, [x for x in label.strip("->").split("&") if x], b, initial))
    return out


def frame(spark, *rows):
    return spark.createDataFrame(list(itertools.chain(*rows)), "sys string, src string, label array<string>, dst string, initial string")


def test_stuttering_and_clusters(spark):
    df = frame(
        spark,
        moves("p --> q, q -a-> r", "tau_a"), moves("p -a-> r", "a"), moves("p --> p, p -a-> r", "diverges"), moves("x -a-> y", "renamed", "x"), moves("p -b-> r", "b"),
        moves("p -a-> q, q -b-> r, p -a-> s, s -b-> r", "twice"), moves("p -a-> q, q -b-> r", "once"),
    )
    got = {r.sys: r.representative for r in systems.clusters(df).collect()}
    assert got["tau_a"] == got["a"] == got["renamed"] and got["twice"] == got["once"] == "once"
    assert len({got["a"], got["diverges"], got["b"], got["once"]}) == 4
    block = {(r.sys, r.state): (r.block, r.divergent) for r in systems.stuttering(df).collect()}
    assert block["tau_a", "p"] == block["tau_a", "q"] and block["diverges", "p"][1] and not block["diverges", "r"][1]
    assert systems.quotients(df.filter("sys = 'tau_a'")).count() == 1


def test_divergence_two_cycle_and_propagation():
    m = [("a", (), "b"), ("b", (), "c"), ("c", (), "b"), ("d", ("x",), "a"), ("e", (), "e")]
    assert plain_graphs.divergent("abcde", m) == {"a", "b", "c", "e"}


def test_dominators(spark):
    diamond = [("g", "a", "b", "a"), ("g", "a", "c", "a"), ("g", "b", "d", "a"), ("g", "c", "d", "a"), ("g", "d", "a2", "a")]
    got = {r.node: r for r in graph.dominators(spark.createDataFrame(diamond, "graph string, src string, dst string, root string")).collect()}
    assert got["d"].immediate == "a" and got["b"].frontier == ["d"] and got["a"].frontier == [] and got["a2"].dominators == ["a", "a2", "d"]


def test_reach_components_paths(spark):
    rng = random.Random(1)
    pairs = sorted({(rng.randint(0, 11), rng.randint(0, 11)) for _ in range(16)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    roots = spark.createDataFrame([(pairs[0][0],)], "node long")
    assert {r.node for r in graph.reachable(edges, roots).collect()} == plain_graphs.reach([pairs[0][0]], pairs)
    nodes = {n for p in pairs for n in p}
    assert {r.node: r.component for r in graph.strong_components(edges).collect()} == plain_graphs.components(nodes, pairs)
    ends = {max(nodes)}
    found = graph.simple_paths(edges, roots, spark.createDataFrame([(max(nodes),)], "node long"), longest=6)
    want = plain_graphs.paths([pairs[0][0]], ends, pairs, True, 6, 10**6)
    assert sorted(map(tuple, (r.path for r in found.collect()))) == sorted(map(tuple, want))


def test_conformance(spark):
    df = frame(spark, moves("p -a-> q, q -b-> r", "ok"), moves("p -a-> q, p -a-> s, s -b-> t", "bad"), moves("p -a-> p, p -b-> q", "loop"), moves("p -c-> q", "other"))
    rules = {"r": "G(a -> F b)"}
    got = {x.sys: (x.verdict, x.counterexample, x.unmatched, x.cyclic) for x in systems.conformance(df, rules).collect()}
    assert got["ok"] == ("COMPLIANT", [], [], False) and got["bad"] == ("VIOLATION", ["a"], [], False)
    assert got["loop"][0] == "COMPLIANT" and got["loop"][3] and got["other"] == ("INCONCLUSIVE", [], ["a", "b"], False)
    v = spark.createDataFrame([("x", "COMPLIANT"), ("x", "VIOLATION"), ("y", "INCONCLUSIVE"), ("y", "COMPLIANT"), ("z", "ERROR")], "sys string, verdict string")
    assert {r.sys: r.overall for r in gates.overall(v, ["sys"]).collect()} == {"x": "FAIL", "y": "PASS", "z": "INCONCLUSIVE"}


def test_contract():
    assert graphs.contract({"a": False, "p": True, "b": False}, [("a", "x", "p"), ("p", None, "b")]) == ({"a", "b"}, [("a", "x", "b")])
    assert graphs.contract({"a": False, "p": True, "b": False}, [("a", "x", "p"), ("p", "y", "b")])[0] == {"a", "p", "b"}


def test_metrics(spark):
    assert metrics.exact_interval(0, 0) == (0.0, 1.0) and metrics.exact_interval(0, 10)[0] == 0.0 and metrics.exact_interval(10, 10)[1] == 1.0
    low, high = metrics.exact_interval(98, 100)
    assert (round(low, 4), round(high, 4)) == (0.9296, 0.9976)
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 3.0), (4.0, 9.0)], "x double, y double")
    ranks = sorted((r.x, r.r) for r in metrics.average_ranks(df, "x", "r").collect())
    assert ranks == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (4.0, 4.0)]
    y = spark.createDataFrame([(0.1, True), (0.2, True), (0.2, False), (0.9, False)], "s double, p boolean")
    r = metrics.youden(y, "s", F.col("p")).first()
    assert (r.tau, r.j) == (0.2, 0.5)
    zero = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    assert tuple(zero.select(*metrics.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))).first())[:2] == (1.0, 1.0)
    a, b = spark.createDataFrame([("i", 1), ("i", 2)], "item string, k int"), spark.createDataFrame([("i", 2), ("i", 3)], "item string, k int")
    assert tuple(metrics.set_scores(a, b, "item", ["k"]).first()) == ("i", 1, 1, 1)
    t = spark.createDataFrame([("DETECTED",), ("MISSED_COMPLIANT",), ("ABSTAINED_INCONCLUSIVE",)], "verdict_kind string").withColumn("g", F.lit(1))
    assert metrics.trial_rates(t, ["g"]).first().detection == 0.5


def test_text(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 7))), "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 7)))) for _ in range(80)]
    df = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    assert [r[0] for r in df.select(text.lcs_length(F.col("a"), F.col("b"))).collect()] == [lcs(a, b) for a, b in pairs]
    one = spark.createDataFrame([("x >= 1", "while n < 3:", "```py\nf(x)\n``` end", ["start(a)", "done(a)", "b"])], "g string, n string, f string, run array<string>")
    r = one.select(text.atom_name(F.col("g")), text.node_text(F.col("n")), text.fenced(F.col("f")), text.counterexample(F.col("run")), text.calls(F.lit("f(g(x), print(1), f(2))"), ["print"])).first()
    assert tuple(r) == ("x_1", "n < 3", "f(x)", "a → b", ["f", "g", "f"])


def test_match(spark):
    a = spark.createDataFrame([("Send Mail",), ("pay bil",), ("cook",), ("ab",)], "action string")
    t = spark.createDataFrame([("send_mail", 5), ("sendmail2", 1), ("pay bill", 2), ("xyz", 3), ("abc", 4)], "task string, pos int")
    got = {r.action: (r.task, r.tier) for r in match.spelling(a, t).collect()}
    assert got == {"Send Mail": ("send_mail", 1), "pay bil": ("pay bill", 2), "ab": ("abc", 2)}
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    many = match.spelling(spark.createDataFrame([(w,) for w in words[:20]], "action string"), spark.createDataFrame([(w, i) for i, w in enumerate(words[20:])], "task string, pos int"))
    found = {r.action: (r.task, r.tier) for r in many.collect()}

    def dist(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return row[-1]

    for w in set(words[:20]):
        best = next((x for x in words[20:] if x == w), None) or next((x for x in words[20:] if dist(w, x) <= 2), None)
        assert found.get(w, (None,))[0] == best


def test_traces_and_mutants(spark):
    steps = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate("abba")], "case string, pos long, atom string")
    drop = traces.drop_step(steps, "case", "atom").groupBy("mutant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom"))), lambda x: x["atom"]), "").alias("t"))
    assert sorted(r.t for r in drop.collect()) == sorted(["bba", "aba", "aba", "abb"])
    swap = traces.swap_adjacent(steps, "case", "atom").groupBy("mutant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom"))), lambda x: x["atom"]), "").alias("t"))
    assert sorted(r.t for r in swap.collect()) == ["abab", "baba"]
    assert traces.destutter(steps, "case", ["pos"], "atom").count() == 3
    edges = spark.createDataFrame([("g", "f1", "a", "b", "x > 1"), ("g", "f2", "a", "c", None)], "graph string, flow string, src string, dst string, condition string")
    assert {r.condition for r in mutate.invert_condition(edges).filter("flow = 'f1'").collect()} == {"!(x > 1)"} and mutate.delete_flow(edges).count() == 2


XML = """<?xml version="1.0"?><bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL"><bpmn:process id="P">
<bpmn:startEvent id="s"/><bpmn:task id="t1" name="Check it"/><bpmn:exclusiveGateway id="g" default="f4"/><bpmn:userTask id="t2" name="Pay"/><bpmn:subProcess id="u"><bpmn:serviceTask id="t3" name="Ship"/><bpmn:standardLoopCharacteristics id="l"/></bpmn:subProcess><bpmn:endEvent id="e"/>
<bpmn:sequenceFlow id="f1" sourceRef="s" targetRef="t1"/><bpmn:sequenceFlow id="f2" sourceRef="t1" targetRef="g"/><bpmn:sequenceFlow id="f3" sourceRef="g" targetRef="t2"><bpmn:conditionExpression>ok</bpmn:conditionExpression></bpmn:sequenceFlow>
<bpmn:sequenceFlow id="f4" sourceRef="g" targetRef="e"/><bpmn:sequenceFlow id="f5" sourceRef="t2" targetRef="e"/><bpmn:sequenceFlow id="f6" sourceRef="x"/></bpmn:process></bpmn:definitions>"""


def test_bpmn_and_synthesis(spark, tmp_path):
    (tmp_path / "one.bpmn").write_text(XML)
    (tmp_path / "broken.bpmn").write_text("<bpmn:definitions>")
    good, bad = bpmn.checked(bpmn.read(spark, str(tmp_path)))
    assert good.count() == 1 and bad.first().graph == "broken"
    nodes, edges = bpmn.parsed(good)
    by = {r.node: r for r in nodes.collect()}
    assert by["t3"].parent == "u" and by["u"].loop and by["g"].default_flow == "f4" and edges.count() == 5
    assert {r.type: r.n for r in bpmn.census(good).collect()} == {r.type: r["count"] for r in nodes.groupBy("type").count().collect()}
    guarded = {r.flow: r.condition for r in synth.resolve_guards(edges, nodes).collect()}
    assert guarded["f4"] == "!(ok)" and guarded["f3"] == "ok"
    rules = {(r.tier, r.formula) for r in synth.properties(nodes.filter("node not in ('t3', 'u')"), edges).collect()}
    assert ("P1", "!start(Pay) W done(Check_it)") in rules and ("P4", "F(done(Check_it))") in rules and ("P4", "G(start(Pay) -> F(done(Pay)))") in rules and ("P0", "!done(Pay) W start(Pay)") in rules


def test_programs(spark):
    code = "def run(x, y):\n    a = check(x)\n    b = other(y)\n    for i in range(3):\n        if a > 1 and not (b or x == 2):\n            send(a)\n        else:\n            break\n    done(b)\n    return a\n"
    df = spark.createDataFrame([("p", code), ("bad", "def (")], "program string, code string")
    nodes, edges = programs.graphs(df)
    kinds = {r.type: r["count"] for r in nodes.filter("fn = 'run'").groupBy("type").count().collect()}
    assert kinds == {"entry": 1, "task": 4, "loop": 1, "gateway": 1, "break": 1, "return": 1, "exit": 1}
    assert edges.filter("fn = 'run'").count() == 11
    g = spark.createDataFrame([("g", "not (a > 1 or (b and not c))")], "program string, code string")
    r = programs.guard_forms(g).first()
    assert r.cnf == [["a <= 1"], ["not b", "c"]] and r.vars == ["a", "b", "c"]
    s = gates.screening(programs.screened(df, ["check", "other", "send", "done", "range"]), ["parses", "imports_ok", "one_function", "no_async", "known_calls"])
    assert {r.program: r.outcome for r in s.collect()} == {"p": "pass", "bad": "parses"}


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"uid": 1, "tags": ["7", "x"], "source_file": "a"}, {"base_uid": 1, "operator": "o", "site": "s"}]')
    bases, mutants = tables.manifest(spark, str(tmp_path / "m.json"))
    assert bases.count() == 1 and mutants.first().operator == "o"
    wir = '{"nodes": ["a", {"id": "b", "type": "task"}], "edges": [{"source": "a", "dst": "b", "condition": "c"}]}'
    n, e = tables.code_graph(spark.createDataFrame([("p", wir)], "program string, wir string"), "wir")
    assert {r.id: r.type for r in n.collect()} == {"a": None, "b": "task"} and tuple(e.first())[1:4] == ("a", "b", "c")
    out = str(tmp_path / "done")
    tables.append_new(spark.createDataFrame([(1, "x")], "k int, v string"), out, "k")
    assert tables.append_new(spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string"), out, "k").count() == 2
    tables.write_csv(spark.createDataFrame([(1, {"a": 1})], "k int, m map<string,int>"), str(tmp_path / "csv"))
    assert "| 1 |" in tables.markdown(spark.createDataFrame([(1,)], "k int"), "t")


def test_stream(spark, tmp_path):
    from sparktrail.streaming import monitor

    rows = [(c, i, random.Random(c * 50 + i).choice("abc")) for c in range(8) for i in range(9)]
    df = spark.createDataFrame(rows, "case long, pos long, atom string")
    df.filter("pos < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.monitor(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "G(a -> F b)", "case", ["pos"], "atom")
    q = stream.writeStream.outputMode("update").format("memory").queryName("m").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    df.filter("pos >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    last = {r.case: r.holds for r in sorted(spark.table("m").collect(), key=lambda r: r.steps)}
    assert last == {r.case: r.holds for r in monitor.offline(df, "G(a -> F b)", "case", ["pos"], "atom").collect()}


def test_gate_unknown_tier(spark):
    policy = spark.createDataFrame([("P0", True)], "tier string, conformance_check boolean")
    with pytest.raises(Exception, match="unknown tier"):
        gates.gate(spark.createDataFrame([("P9", 0, "F a")], "tier string, ord long, formula string"), policy).collect()
