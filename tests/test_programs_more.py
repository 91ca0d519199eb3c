"""Programs: call order, arms, literals; comparison of recorded runs."""

import ast
import random
import tracemalloc

from pyspark.sql import functions as F
from sparktrail.functions import sequences
from sparktrail.operators import compare, graph, lineage, systems
from sparktrail.sources import bpmn, programs, tables

FLOW = '''
def load(n):
    return n * 2


def check(n, level):
    if n > 10:
        return "high"
    return level


def send(what):
    return what


def run(n: int, level: str):
    n = load(n)
    kind = check(n, level)
    if kind == "high":
        send("urgent")
    else:
        send("normal")
        send("again")
    return kind
'''


def one(df, **where):
    return [r for r in df.collect() if all(r[k] == v for k, v in where.items())]


def test_call_order_and_conformance(spark):
    df = spark.createDataFrame([("p", FLOW), ("flat", "print('x')\n"), ("bad", "def (")], "program string, code string")
    nodes, edges = programs.call_order(df)
    tasks = {r.code for r in nodes.collect() if r.program == "p" and r.type == "task"}
    assert tasks == {"load", "check", "send"} and {r.fn for r in nodes.collect()} == {"run", "<module>"}
    assert edges.filter("program = 'p'").count() == 9
    lifted = programs.call_systems(df.filter("program = 'p'"))
    found = {r.rule: (r.verdict, r.counterexample) for r in systems.conformance(lifted, {"ok": "!send W check", "no": "G(check -> !F(send))", "far": "F(other)"}).collect()}
    assert found["ok"][0] == "COMPLIANT" and found["no"] == ("VIOLATION", ["load", "check", "send"]) and found["far"][0] == "INCONCLUSIVE"
    assert [r.program for r in programs.rejected(df).collect()] == ["bad"]


def test_driver_ties_and_literals(spark):
    tie = "def a():\n    c()\ndef b():\n    c()\ndef c():\n    pass\n"
    assert programs.driver(ast.parse(tie))[0] == "a" and programs.called(ast.parse(FLOW)) == ["load", "check", "send", "send", "send"]
    df = spark.createDataFrame([("p", FLOW)], "program string, code string")
    assert [r.literal for r in programs.guard_literals(df).collect()] == ["high"]
    kinds = lineage.variable_kinds(programs.variables(df)).first()
    assert set(kinds.control) == {"n", "kind"} and "n" not in kinds.data and "what" in kinds.data
    calls = spark.createDataFrame([("p", "f", 1, "x"), ("p", "f", 1, "y"), ("p", "g", 0, "x"), ("p", "g", 0, "y"), ("p", "g", 0, "g")], "program string, fn string, fn_pos int, callee string")
    assert tuple(lineage.drivers(calls).first()) == ("p", "g", 2)


def test_arms(spark):
    code = "def f(x):\n    if x:\n        y = 1\n    else:\n        y = 2\n    while y:\n        y = 0\n    return y\n"
    arms = {r.line: (r.true_line, r.false_line) for r in programs.branch_arms(spark.createDataFrame([("p", code)], "program string, code string")).collect() if r.fn == "f"}
    assert arms == {2: (3, 5), 6: (7, 8)}
    nodes, edges = programs.gold_graph(spark.createDataFrame([("p", "x = 1\nwhile x:\n    if x > 2:\n        break\n    x = 3\ny = 2\n")], "program string, code string"))
    assert {(r.src, r.dst, r.label) for r in edges.collect()} == {("entry", "L1", None), ("L1", "L2", None), ("L2", "L3", "True"), ("L2", "L6", "False"), ("L3", "L4", "True"), ("L3", "L5", "False"), ("L4", "L6", None), ("L5", "L2", None), ("L6", "exit", None)}
    assert {r.node: r.kind for r in nodes.collect()}["L4"] == "break"


def test_guards_beyond_the_old_limit(spark):
    wide = " or ".join(f"(a{i} and b{i})" for i in range(9))
    rows = [("wide", wide), ("bad", "a >"), ("ok", "a and b")]
    got = {r.program: (r.cnf, r.reason) for r in programs.guard_forms(spark.createDataFrame(rows, "program string, code string")).collect()}
    assert got["wide"] == (None, "too many clauses") and got["bad"][0] is None and "SyntaxError" in got["bad"][1] and got["ok"] == ([["a"], ["b"]], None)


def test_comparison_by_mode(spark):
    e = lambda side, pos, event, task=None, taken=None, value=None: ("r", side, pos, event, task, taken, value, None)
    rows = [e("expected", 0, "task_entry", "a"), e("expected", 1, "branch_point", taken=True), e("expected", 2, "task_exit", "a"), e("expected", 3, "return_value", value="1"),
            e("actual", 0, "task_entry", "helper"), e("actual", 1, "task_entry", "a"), e("actual", 2, "branch_point", taken=False), e("actual", 3, "branch_point"), e("actual", 4, "task_exit", "a")]
    df = spark.createDataFrame(rows, compare.EVENTS)
    got = {r.mode: r for r in compare.both_modes(df).collect()}
    assert got["strict"].actual == ["task_entry:a", "branch_point", "branch_point", "task_exit:a"] and got["strict"].expected == ["task_entry:a", "branch_point", "task_exit:a"]
    assert got["strict"].lcs_length == 3 and not got["strict"].passed and [d.kind for d in got["strict"].divergences] == ["extra_in_actual"]
    assert got["task_only"].passed and got["task_only"].similarity == 1.0
    assert sequences.partings(list("abcd"), list("axcy"), 5) == [("missing_in_actual", 1, "x"), ("extra_in_actual", 1, "b"), ("missing_in_actual", 3, "y"), ("extra_in_actual", 3, "d")]


def test_broken_diagrams_and_recovery(spark, tmp_path):
    good = '<definitions xmlns="x"><process><task id="t"/><custom id="c"/><subProcess id="u"><task id="v"/></subProcess></process><BPMNDiagram><task id="drawn"/></BPMNDiagram></definitions>'
    for name, xml in {"good": good, "open": "<definitions><task id='x'></definitions>", "other": "<html/>", "twice": good + "</definitions>"}.items():
        (tmp_path / f"{name}.bpmn").write_text(xml)
    ok, bad = bpmn.checked(bpmn.read(spark, str(tmp_path)))
    assert [r.graph for r in ok.collect()] == ["good"] and {r.graph for r in bad.collect()} == {"open", "other", "twice"}
    assert all(r.reason for r in bad.collect()) and bpmn.recovery(ok).count() == 0
    assert {(r.type, r.n) for r in lineage.unsupported(bpmn.elements(ok).filter("NOT shown"), [*bpmn.NODE_TYPES, "definitions", "process"]).collect()} == {("custom", 1)}


def test_diagrams_keep_their_texts(spark):
    odd = """<?xml version="1.0"?><!-- </b:definitions> --><b:definitions xmlns:b="u" xmlns:i="v"><b:process id="P"><b:task id="007" name="1.50" i:id="zz"/><b:transaction id="T"><b:task id='true'/>
<b:subProcess id="o"><b:subProcess id="u"><b:multiInstanceLoopCharacteristics/><b:userTask id="é" name=""/></b:subProcess></b:subProcess></b:transaction><b:task/>
<b:sequenceFlow id="f" sourceRef="007" targetRef="true"><b:conditionExpression type="x"> a &lt; 1 and b:c="2" </b:conditionExpression></b:sequenceFlow><b:sequenceFlow sourceRef="007" targetRef="é" name="yes"/>
<b:sequenceFlow id="g" sourceRef="true" targetRef="é"><b:conditionExpression><![CDATA[10]]></b:conditionExpression></b:sequenceFlow></b:process></b:definitions>"""
    df = spark.createDataFrame([("odd", odd), ("empty", "<definitions/>"), ("none", None), ("blank", ""), ("text", "007")], "graph string, xml string")
    ok, bad = bpmn.checked(df)
    assert {r.graph for r in ok.collect()} == {"odd", "empty"} and {r.graph for r in bad.collect()} == {"none", "blank", "text"}
    nodes, edges = bpmn.parsed(df)
    got = {(r.node, r.type, r.name, r.parent, r.loop) for r in nodes.collect()}
    assert got == {("007", "task", "1.50", None, False), ("true", "task", "true", None, False), ("o", "subProcess", "o", None, False), ("u", "subProcess", "u", "o", True), ("é", "userTask", "é", "u", False)}
    assert {(r.flow, r.src, r.dst, r.condition) for r in edges.collect()} == {("f", "007", "true", 'a < 1 and b:c="2"'), (None, "007", "é", "yes"), ("g", "true", "é", "10")}
    assert "Python" not in nodes._jdf.queryExecution().toString() and bpmn.parsed(df.filter("false"))[0].count() == 0


def test_more_sources(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("tests:\n- _metadata: {uid: 3, tags: ['7', loops]}\n  expected_output: {sequence: ['a then b']}\n")
    r = tables.yaml_cases(spark, str(tmp_path / "c.yaml")).select("uid", "sequence", lineage.first_tag(__import__("pyspark.sql.functions", fromlist=["col"]).col("tags")).alias("tag")).first()
    assert tuple(r) == (3, "a then b", "loops")
    for k in range(4):
        (tmp_path / "d" / f"s{k}").mkdir(parents=True)
        (tmp_path / "d" / f"s{k}" / "My file.bpmn").write_text("<x/>")
    assert [r.name for r in tables.pairs(spark, str(tmp_path / "d"), 3).collect()][0].startswith("model_s0_my") and tables.pairs(spark, str(tmp_path / "d"), 3).count() == 3
    wir = '{"control_variables": ["a"], "types": {"b": "int", "c": "Any"}}'
    got = {(r.variable, r.known) for r in tables.typed_variables(spark.createDataFrame([("p", wir)], "program string, wir string"), "wir").collect()}
    assert got == {("a", True), ("b", True), ("c_ANY", False)}


def by_table(a, b, most=None):
    """The same places from the whole table of lengths."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            n[i][j] = n[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(n[i - 1][j], n[i][j - 1])
    places, i, j = [], len(a), len(b)
    while i > 0 or j > 0:
        if i > 0 and j > 0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j == 0 or (i > 0 and n[i - 1][j] >= n[i][j - 1]):
            i -= 1
            places.insert(0, ("extra_in_actual", i, a[i]))
        else:
            j -= 1
            places.insert(0, ("missing_in_actual", j, b[j]))
    return (places if most is None else places[len(places) - min(most, len(places)) :]), n[-1][-1]


def test_partings_equal_the_whole_table():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert (sequences.partings(a, b), sequences.common(a, b)) == by_table(a, b)
        assert sequences.partings(a, b, 3) == by_table(a, b, 3)[0]


def test_long_sequences_take_little_memory():
    rng = random.Random(7)
    a = [f"t{rng.randint(0, 300)}" for _ in range(50_000)]
    b = [x for x in a if rng.random() > 0.01]
    tracemalloc.start()
    found = sequences.partings(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(a) + len(b) - 2 * sequences.common(a, b) == len(a) - len(b) and peak < 60 << 20


def test_runs_by_recorded_events(spark):
    """Admission, control and classes from events of runs, as rows."""
    pairs = [("same", k, str(k), ["a"], "1", ["a"], "1") for k in range(4)] + [("late", k, str(k), ["a"], "1", ["a"], "2") for k in range(4)] + [("bug", 0, "0", ["a"], "1", ["b"], "1"), ("bug", 1, "1", ["a"], "1", ["a"], "1"), ("raise", 0, "0", ["a"], "1", ["a"], "__exception__:KeyError")]
    df = spark.createDataFrame(pairs, "variant string, ord int, input string, base_calls array<string>, base_return string, variant_calls array<string>, variant_return string")
    adm = compare.admission(df, ["variant"])
    got = {r.variant: (r.runs, r.difference_rate, r.admitted) for r in adm.collect()}
    assert got == {"same": (4, 0.0, True), "late": (4, 1.0, False), "bug": (2, 0.5, False), "raise": (1, 1.0, False)}
    scores = spark.createDataFrame([("late", 0.9), ("bug", 0.95), ("raise", 1.0), ("same", 1.0)], "variant string, confidence double")
    assert {r.variant: r.same_calls for r in compare.logic_misses(adm, scores, 0.9).collect()} == {"late": True, "bug": False}
    e = lambda run, side, pos, event, **x: (run, side, pos, event, x.get("task"), x.get("taken"), x.get("value"), None)
    rows = [e(run, side, k, "task_entry", task=t) for run in "xy" for side in ("actual", "expected") for k, t in enumerate("abc")]
    rows += [e("y", "actual", 9, "return_value", value="1"), e("y", "expected", 9, "return_value", value="2"), e("z", "actual", 0, "branch_point"), e("z", "expected", 0, "task_entry", task="a")]
    runs = compare.compared(spark.createDataFrame(rows, compare.EVENTS))
    assert {r.run_id: (r.passed, r.parted) for r in runs.collect()} == {"x": (True, 0), "y": (False, 2), "z": (False, 2)}
    assert {(r.run_id, r.source) for r in compare.divergence_sources(runs, ["run_id"]).collect()} == {("y", "return_value"), ("z", "branch_point"), ("z", "task_entry")}
    scored = compare.verification(runs.withColumn("input", F.col("run_id")).withColumn("v", F.lit("v")), ["v"], "input").first()
    assert (scored.runs, scored.matching) == (3, 1)
