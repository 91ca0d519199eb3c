"""Systems of all sizes at once against plain algorithms on each."""

import random
from collections import defaultdict, deque

import plain_graphs
import pytest
from pyspark.sql import functions as F
from sparktrail.operators import graph, systems
from sparktrail.plans import formula as fm
from sparktrail.sources import programs

MOVES = "sys string, src string, label array<string>, dst string, initial string"


def random_systems(n, seed, states=6, moves=10):
    rng, out = random.Random(seed), []
    for s in range(n):
        k = rng.randint(1, states)
        out += [(f"s{s}", f"q{rng.randrange(k)}", rng.choice([[], [], ["a"], ["b"], ["a", "b"]]), f"q{rng.randrange(k)}", "q0") for _ in range(rng.randint(0, moves))]
        out.append((f"s{s}", "q0", [], None, "q0"))
    return out


def by_system(rows):
    out = defaultdict(list)
    for sys, src, label, dst, _ in rows:
        out[sys].append((src, tuple(sorted(label)), dst))
    return out


def plain_blocks(moves):
    states = sorted({s for a, _, b in moves for s in (a, b) if s is not None})
    real = [m for m in moves if m[2] is not None]
    block, bad = plain_graphs.refine(states, real), plain_graphs.divergent(states, real)
    least = {}
    for s in states:
        least.setdefault(block[s], s)
    return {s: (least[block[s]], s in bad) for s in states}, real


def test_blocks_and_quotients(spark):
    rows = random_systems(60, 3)
    df = spark.createDataFrame(rows, MOVES)
    want, quotients = {}, set()
    for sys, moves in by_system(rows).items():
        blocks, real = plain_blocks(moves)
        want |= {(sys, s): b for s, b in blocks.items()}
        quotients |= {(sys, blocks[a][0], x, blocks[b][0]) for a, x, b in real if x or blocks[a][0] != blocks[b][0]}
    assert {(r.sys, r.state): (r.block, r.divergent) for r in systems.stuttering(df).collect()} == want
    assert any(b[1] for b in want.values()) and len({b for b in want.values()}) > 5
    assert {(r.sys, r.src, tuple(r.label), r.dst) for r in systems.quotients(df).collect()} == quotients


def test_cycle_beside_none(spark):
    """A silent cycle is told apart from none, and silent cycles of several states are one block."""
    rows = [("loop", "p", [], "q", "p"), ("loop", "q", [], "p", "p"), ("loop", "q", ["a"], "r", "p"), ("none", "p", [], "q", "p"), ("none", "q", ["a"], "r", "p"), ("self", "p", [], "p", "p"), ("self", "p", ["a"], "r", "p")]
    df = spark.createDataFrame(rows, MOVES)
    pairs = spark.createDataFrame([("loop", "none"), ("loop", "self"), ("none", "self"), ("loop", "loop")], "a string, b string")
    assert {(r.a, r.b): r.bisimilar for r in systems.bisimilar(df, pairs).collect()} == {("loop", "none"): False, ("loop", "self"): True, ("none", "self"): False, ("loop", "loop"): True}
    assert {r.sys: r.representative for r in systems.clusters(df).collect()} == {"loop": "self", "self": "self", "none": "none"}


def test_one_large_system(spark):
    """Twelve rungs of 1,500 states: all states of a rung are equivalent, silent detours included."""
    rungs, wide = 12, 1500
    ids = spark.range(rungs * wide)
    level, k = F.floor(F.col("id") / wide), F.col("id") % wide
    name = lambda lv, i: F.concat(F.lit("n"), F.lpad(lv.cast("string"), 3, "0"), F.lit("_"), F.lpad(i.cast("string"), 5, "0"))
    label = F.array(F.when(level % 2 == 0, "a").otherwise("b"))
    ahead = ids.filter(level < rungs - 1).select(name(level, k).alias("src"), label.alias("label"), name(level + 1, (k * 7 + 1) % wide).alias("dst"))
    side = ids.filter("id % 3 = 0").filter(level < rungs - 1).select(name(level, k).alias("src"), F.array().cast("array<string>").alias("label"), name(level, (k + 1) % wide).alias("dst"))
    m = ahead.unionByName(side).withColumn("sys", F.lit("one")).withColumn("initial", F.lit("n000_00000"))
    out = systems.stuttering(m)
    assert out.count() == rungs * wide
    got = {(r.level, r.block) for r in out.select(F.substring("state", 2, 3).alias("level"), "block").distinct().collect()}
    assert got == {(f"{i:03d}", f"n{i:03d}_00000") for i in range(rungs)}


def plain_check(initial, moves, rule):
    """Verdict and least shortest bad run, by search over (state, automaton state, run) without a cap on runs but their number of nodes."""
    f = fm.parse(rule)
    atoms = sorted(set(fm.atoms(f)))
    if set(atoms) - {a for _, x, _ in moves for a in x}:
        return "INCONCLUSIVE", []
    table, good = fm.automaton(f, [*atoms, None])
    delta = {(s, x): t for s, x, t in table}
    out = defaultdict(list)
    for a, x, b in moves:
        out[a].append((x, b))
    level, seen, ended = {(initial, 0): ()}, set(), False
    while level:
        todo = deque(level)
        while todo:  # silent moves, with better runs told on
            s, q = todo.popleft()
            for x, t in out[s]:
                if not x and (t, q) not in seen and ((t, q) not in level or level[s, q] < level[t, q]):
                    level[t, q] = level[s, q]
                    todo.append((t, q))
        ends = {n: r for n, r in level.items() if not out[n[0]]}
        ended |= bool(ends)
        bad = [r for (s, q), r in ends.items() if not good[q] or not r]
        if bad:
            return "VIOLATION", list(min(bad))
        seen |= set(level)
        ahead = {}
        for (s, q), run in level.items():
            for x, t in out[s]:
                if x:
                    n, r = (t, delta[q, next((a for a in x if a in atoms), None)]), (*run, " & ".join(x))
                    if n not in seen and (n not in ahead or r < ahead[n]):
                        ahead[n] = r
        level = ahead
    return ("COMPLIANT" if ended else "INCONCLUSIVE"), []


def test_conformance_on_random_systems(spark):
    rows = random_systems(50, 4, states=5, moves=7)
    rules = {"r": "G(a -> F b)", "w": "!b W a", "x": "F(a & X b)"}
    got = {(r.sys, r.rule): (r.verdict, r.counterexample) for r in systems.conformance(spark.createDataFrame(rows, MOVES), rules).collect()}
    want = {(s, n): plain_check("q0", sorted(m for m in set(moves) if m[2] is not None), t) for s, moves in by_system(rows).items() for n, t in rules.items()}
    assert got == want and {v for v, _ in want.values()} == {"VIOLATION", "COMPLIANT", "INCONCLUSIVE"}


def test_no_finite_run_is_inconclusive(spark):
    rows = [("ring", "a", ["x"], "b", "a"), ("ring", "b", ["z"], "a", "a"), ("exit", "a", ["z"], "a", "a"), ("exit", "a", ["y"], "c", "a"), ("good", "a", ["z"], "b", "a"), ("good", "b", ["z"], "b", "a"), ("good", "b", ["y"], "c", "a"), ("still", "a", [], None, "a")]
    got = {r.sys: (r.verdict, r.counterexample, r.unmatched, r.cyclic) for r in systems.conformance(spark.createDataFrame(rows, MOVES), {"r": "F z"}).collect()}
    assert got == {"ring": ("INCONCLUSIVE", [], [], True), "exit": ("VIOLATION", ["y"], [], True), "good": ("COMPLIANT", [], [], True), "still": ("INCONCLUSIVE", [], ["z"], False)}
    assert systems.conformance(spark.createDataFrame([], MOVES), {"r": "F z"}).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range((40, 75, 140)[seed - 1])] + [(100 + k, 101 + k) for k in range(9)]
    nodes = {n for p in pairs for n in p}
    got = {r.node: (r.component, r.size, r.cyclic) for r in graph.strong_components(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    want = plain_graphs.components(nodes, sorted(set(pairs)))
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert got == {n: (c, sizes[c], sizes[c] > 1 or (n, n) in pairs) for n, c in want.items()}
    loops = {n for n, (_, _, c) in got.items() if c}
    assert {r.node for r in graph.divergence(spark.createDataFrame(pairs, "src int, dst int")).collect()} == plain_graphs.reach(loops, pairs, back=True)


def test_components_of_a_large_graph(spark):
    """10^5 nodes: rings of 5 nodes, two of them in a chain."""
    n = 100_000
    ring = spark.range(n).select("id", (F.col("id") - F.col("id") % 5 + (F.col("id") % 5 + 1) % 5).alias("dst"))
    edges = ring.select(F.col("id").alias("src"), "dst").unionByName(ring.filter("id % 10 = 3").select(F.col("id").alias("src"), (F.col("id") + 5).alias("dst")))
    r = graph.strong_components(edges).agg(F.count("*").alias("n"), F.countDistinct("component").alias("c"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.bool_and(F.col("component") == F.col("node") - F.col("node") % 5).alias("ok")).first()
    assert (r.n, r.c, r.lo, r.hi, r.ok) == (n, n // 5, 5, 5, True)


def test_report(spark):
    rows = [("s", "a", ["x"], "b", "a"), ("s", "a", [], "c", "a"), ("s", "d", [], "a", "a"), ("t", "a", [], None, "a")]
    got = {r.sys: tuple(r)[1:] for r in systems.lift_report(spark.createDataFrame(rows, MOVES)).collect()}
    assert got == {"s": (4, 2, 1, 2, 1, 1), "t": (1, 0, 0, 1, 0, 1)}


def test_equal_systems_are_worked_on_once(spark):
    """Copies under other names stand for one another, with null ends, empty labels and other first states told apart."""
    rows = random_systems(40, 6)
    rows += [("b0", "x", [], None, "x"), ("b1", None, [], "x", "x"), ("b2", "x", [], "y", "x"), ("b3", "x", ["y"], None, "x"), ("b4", "x", [], "y", "y")]
    df = spark.createDataFrame(rows + [(f"z{s}", *r) for s, *r in rows for _ in range(2)], MOVES)
    names, kept = systems.alike(df, "sys", "initial")
    like = {r.sys: r.like for r in names.collect()}
    sets = defaultdict(set)
    for s, src, label, dst, first in rows:
        sets[s].add((src, tuple(sorted(label)), dst, first))
    assert all(like["z" + s] == like[s] == min(t for t in sets if sets[t] == sets[s]) for s in sets)
    assert {r.sys for r in kept.select("sys").distinct().collect()} == set(like.values()) and len({like[f"b{k}"] for k in range(5)}) == 5
    want = {(s, state): bad for s, moves in by_system(rows).items() if s[0] == "s" for state, (_, bad) in plain_blocks(moves)[0].items()}
    got = {(r.sys, r.state): r.divergent for r in systems.divergent(df).collect()}
    assert {k: v for k, v in got.items() if k[0][0] == "s"} == want == {(k[0][1:], k[1]): v for k, v in got.items() if k[0][:2] == "zs"} and any(want.values())


def test_programs_with_one_text_are_parsed_once(spark):
    df = spark.createDataFrame([("p2", "a()"), ("p1", "a()"), ("q", "b()"), ("n1", None), ("n0", None), (None, "b()")], "program string, code string")
    names, texts = programs.alike(df)
    assert {tuple(r) for r in names.collect()} == {("p2", "p1"), ("p1", "p1"), ("q", "q"), ("n1", "n0"), ("n0", "n0")}
    assert {tuple(r) for r in texts.collect()} == {("p1", "a()"), ("q", "b()"), ("n0", None)}


def test_conformance_broadcasts_no_table(spark, monkeypatch):
    plans = []

    def settled(df, keep=graph.settled):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    for module in (graph, systems, programs):
        monkeypatch.setattr(module, "settled", settled)
    texts = spark.createDataFrame([(f"p{k}", "def a():\n    pass\ndef b():\n    pass\ndef run():\n" + "".join(f"    {f}()\n" for f in calls)) for k, calls in enumerate(("ab", "ba", "ab", "b"))], "program string, code string")
    names, one = programs.alike(texts)
    told = systems.conformance(programs.call_systems(one), {"then": "G(a -> F(b))", "not": "!b W a"}).withColumnRenamed("sys", "like")
    found = {(r.program, r.rule): r.verdict for r in names.join(told.hint("merge"), "like").collect()}
    assert found == {(p, r): v for p, vs in (("p0", "CC"), ("p1", "VV"), ("p2", "CC"), ("p3", "II")) for r, v in zip(("then", "not"), ({"C": "COMPLIANT", "V": "VIOLATION", "I": "INCONCLUSIVE"}[x] for x in vs), strict=True)}
    assert not [p for p in plans if "BroadcastHashJoin" in p]
