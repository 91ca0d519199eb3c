"""The tree of dominators, its frontiers and its tests against the definition: ways without a node."""

import random

import pytest
from pyspark.sql import functions as F

from sparktrail.operators import dominance


def reach_without(start, pairs, gone):
    seen, todo = set(), [] if start == gone else [start]
    while todo:
        a = todo.pop()
        seen.add(a)
        todo += [b for x, b in pairs if x == a and b not in seen and b != gone]
    return seen


def _graphs():
    rng = random.Random(5)
    for g in range(30):
        n = rng.choice([1, 2, 5, 9, 14])
        shape = rng.choice(["random", "chain", "ladder", "loops"])
        pairs = [(i, i + 1) for i in range(n - 1)] if shape != "random" else []
        if shape == "ladder":
            pairs += [(i, i + 2) for i in range(0, n - 2, 2)]
        if shape == "loops":
            pairs += [(i, rng.randrange(i + 1)) for i in range(0, n, 3)]
        if shape == "random":
            pairs += [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]
        yield g, n, pairs


def test_against_the_definition(spark):
    rows, want = [], {}
    for g, n, pairs in _graphs():
        rows += [(g, a, b) for a, b in pairs] + [(g, 0, None)]
        every = reach_without(0, pairs, None)
        dom = {v: {d for d in every if d == v or v not in reach_without(0, pairs, d)} for v in every}
        for v in every:
            up = max(dom[v] - {v}, key=lambda d: len(dom[d]), default=None)
            front = sorted(b for b in every if any(a in dom and v in dom[a] for a, t in pairs if t == b) and (v == b or v not in dom[b]))
            want[g, v] = (up, sorted(dom[v], key=lambda d: len(dom[d])), front, len(dom[v]) - 1)
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct("g", F.col(c).alias("n")))
    e = spark.createDataFrame(rows + rows[:40], "g long, a long, b long").select(node("a").alias("src"), node("b").alias("dst"), F.lit(1).alias("node"))
    roots = spark.range(30).select(F.struct(F.col("id").alias("g"), F.lit(0).cast("bigint").alias("n")).alias("node"))
    t = dominance.tree(e, roots)
    fronts = dominance.frontier(e, t).groupBy("node").agg(F.array_sort(F.collect_set("front.n")).alias("front"))
    got = {(r.node.g, r.node.n): (r.up and r.up.n, [d.n for d in r.dominators], r.front or [], r.depth) for r in t.join(dominance.above(t), "node").join(fronts, "node", "left").collect()}
    assert got == want
    names = [(v, d) for v in want for d in want if v[0] == d[0]]
    pairs = spark.createDataFrame([(*d, v[1]) for v, d in names], "g long, a long, b long").select(node("a").alias("a"), node("b").alias("b"))
    told = {(r.a.g, r.b.n, r.a.n): r.dominates for r in dominance.dominates(t, pairs).collect()}
    assert told == {(v[0], v[1], d[1]): d[1] in want[v][1] for v, d in names}


def test_diamonds(spark):
    edges = [("entry", "A"), ("entry", "B"), ("A", "merge1"), ("B", "merge1"), ("merge1", "C"), ("merge1", "D"), ("C", "merge2"), ("D", "merge2"), (None, "A"), ("lost", "A"), ("A", "A")]
    e = spark.createDataFrame(edges, "src string, dst string")
    t = dominance.tree(e, spark.createDataFrame([("entry",), (None,)], "node string"))
    assert {r.node: r.up for r in t.collect()} == {"entry": None, "A": "entry", "B": "entry", "merge1": "entry", "C": "merge1", "D": "merge1", "merge2": "merge1"}
    assert {(r.node, r.front) for r in dominance.frontier(e.filter("src <> dst"), t).collect()} == {("A", "merge1"), ("B", "merge1"), ("C", "merge2"), ("D", "merge2")}
    pairs = spark.createDataFrame([("merge1", "D"), ("A", "D"), ("lost", "A"), ("entry", "lost")], "a string, b string")
    assert {r.a: r.dominates for r in dominance.dominates(t, pairs).filter("b <> 'lost'").collect()} == {"merge1": True, "A": False, "lost": False}


@pytest.mark.parametrize("roots", [[], ["x"]])
def test_nothing_to_reach(spark, roots):
    none = spark.createDataFrame([], "src string, dst string")
    t = dominance.tree(none, spark.createDataFrame([(r,) for r in roots], "node string"))
    assert [(r.node, r.up, r.depth) for r in t.collect()] == [(r, None, 0) for r in roots] and dominance.frontier(none, t).count() == 0


def test_a_ladder_of_many_rungs(spark):
    """Two long sides that meet at their end only: one task never holds a graph, and rounds stay few."""
    n = 24
    side = lambda s: [("root", f"{s}{0:03}")] + [(f"{s}{i:03}", f"{s}{i + 1:03}") for i in range(n)] + [(f"{s}{n:03}", "end")]
    e = spark.createDataFrame(side("l") + side("r") + [("l010", "r020"), ("end", "l005"), ("end", "tail")], "src string, dst string")
    up = {r.node: r.up for r in dominance.tree(e, spark.createDataFrame([("root",)], "node string")).collect()}
    assert up["end"] == "root" and up["tail"] == "end" and up["l005"] == "root" and up["r020"] == "root" and up["r024"] == "r023" and up["l004"] == "l003"


def test_peeled_and_deep(spark, monkeypatch):
    """The definition again, where nodes are peeled off and nearest ancestors don't reach the root."""
    monkeypatch.setattr(dominance, "FEW", 0)
    monkeypatch.setattr(dominance, "LEVELS", 1)
    test_against_the_definition(spark)


def test_a_deep_tree(spark):
    """A chain longer than the nearest ancestors told, a second way around most of it, and an edge back."""
    edges = [(i, i + 1) for i in range(70)] + [(5, 100), (100, 60), (69, 40)]
    e = spark.createDataFrame(edges, "src int, dst int")
    t = dominance.tree(e, spark.createDataFrame([(0,)], "node int")).collect()
    want = {i: i - 1 for i in range(1, 71)} | {0: None, 100: 5, 60: 5, 40: 5}
    assert {r.node: r.up for r in t} == want
    depth = lambda i: 0 if want[i] is None else 1 + depth(want[i])
    assert {r.node: r.depth for r in t} == {i: depth(i) for i in want}
    fronts = dominance.frontier(e, spark.createDataFrame(t, "node int, up int, depth int")).collect()
    assert sorted((r.node, r.front) for r in fronts) == sorted([(i, 40) for i in [*range(6, 40), *range(60, 70)]] + [(i, 60) for i in [*range(40, 60), 100]])


def test_no_table_of_nodes_is_sent_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(dominance, "FEW", 0, raising=False)
    ran = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {ran.executionsList().apply(i).executionId() for i in range(ran.executionsList().size())}
    e = spark.createDataFrame([(i // 2, i) for i in range(2, 40)] + [(i // 3, i) for i in range(5, 40, 5)], "src long, dst long")
    t = dominance.tree(e, spark.range(1, 2).withColumnRenamed("id", "node"))
    assert dominance.frontier(e, t).count() > 0
    bus.waitUntilEmpty()
    new = [x for i in range(ran.executionsList().size()) if (x := ran.executionsList().apply(i)).executionId() not in before]
    assert new and not [x.physicalPlanDescription() for x in new if "Broadcast" in x.physicalPlanDescription()]
