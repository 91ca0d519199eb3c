"""Counts of traces by depth against all traces listed, and the sides of the cases told in the docstring."""

import itertools
import random

from pyspark.sql import functions as F

from sparktrail.operators import agreement, alignment
from sparktrail.plans import formula as fm

MOVES = "graph string, src string, label string, dst string, initial string"


def _listed(moves, rules, atoms, k):
    steps = {(a, x, b) for _, a, x, b, _ in moves if x is not None and b is not None}
    busy = {a for a, _, _ in steps}
    spec = {t for n in range(1, k + 1) for t in itertools.product(atoms, repeat=n) if all(fm.holds(fm.parse(r), [{a} for a in t]) for r in rules)}
    model, now = set(), {((), "0")}
    for _ in range(k):
        now = {((*t, x), b) for t, s in now for a, x, b in steps if a == s}
        model |= {t for t, s in now if s not in busy}
    return spec, model


def test_against_listed_traces(spark):
    rng, rules, atoms, moves = random.Random(2), ["G(a -> F(b))", "!c W a"], ["a", "b", "c"], {}
    for g in range(6):
        n = rng.randint(2, 5)
        own = [(str(g), str(rng.randrange(n)), rng.choice("abcd"), str(rng.randrange(n + 1)), "0") for _ in range(7)]
        moves[str(g)] = [*own, own[0], (str(g), "0", "a", str(n), "0"), (str(g), "0", None, "1", "0"), (str(g), "0", "b", None, "0")]
    df = spark.createDataFrame([m for ms in moves.values() for m in ms], MOVES).withColumn("n", F.lit(7))
    got = {(r.graph, r.k): (int(r.agreed), int(r.spec_only), int(r.model_only)) for r in agreement.by_depth(df, rules, atoms, 4).collect()}
    for (g, k), told in got.items():
        spec, model = _listed(moves[g], rules, atoms, k)
        assert told == (len(spec & model), len(spec - model), len(model - spec)), (g, k)
    assert len(got) == 24


def test_many_steps_and_convergence(spark):
    """Twenty steps of five atoms: 5 + 25 + ... traces are counted, none is listed."""
    loop = spark.createDataFrame([("l", "0", "a", "0", "0"), ("l", "0", "b", "1", "0")], MOVES)
    told = agreement.by_depth(loop, [], list("abcde"), 20)
    last = told.filter("k = 20").first()
    assert int(last.agreed) == 20 and int(last.spec_only) == sum(5**k for k in range(1, 21)) - 20 and int(last.model_only) == 0
    assert agreement.converged(told.filter("k = 1")).first()[1:] == (False, 1, told.filter("k = 1").first().f1)
    one = spark.createDataFrame([("x", "0", "a", "1", "0"), ("x", "1", "b", "2", "0")], MOVES)
    told = agreement.by_depth(one, ["a & X(b)", "G(b -> !X(a)) & G(b -> !X(b))"], ["a", "b"], 4)
    old = alignment.deepened(alignment.rule_traces(spark, ["a & X(b)", "G(b -> !X(a)) & G(b -> !X(b))"], ["a", "b"]), alignment.model_traces(one, "0"), 4)
    assert [(int(r.agreed), int(r.spec_only), int(r.model_only), r.f1) for r in told.orderBy("k").collect()][: len(old[0])] == [(h["agreed"], h["spec_only"], h["model_only"], h["f1"]) for h in old[0]]
    assert agreement.converged(told).first()[1:] == (old[1], old[0][-1]["k"], old[0][-1]["f1"])


def test_nothing(spark):
    none = spark.createDataFrame([], MOVES)
    assert agreement.by_depth(none, ["F(a)"], ["a"], 2).count() == 0
    stuck = spark.createDataFrame([("s", "1", "a", "2", "0")], MOVES)
    assert [(int(r.agreed), int(r.spec_only), int(r.model_only), r.precision, r.recall) for r in agreement.by_depth(stuck, ["a & !a"], ["a"], 1).collect()] == [(0, 0, 0, 1.0, 1.0)]


def test_suite_counted_once_and_equal_models_alike(spark):
    rules, atoms = ["G(a -> F(b))", "!c W a"], ["a", "b", "c"]
    spec = [sum(1 for t in itertools.product(atoms, repeat=n) if all(fm.holds(fm.parse(r), [{a} for a in t]) for r in rules)) for n in range(1, 5)]
    assert agreement.Suite(rules, atoms).counts(4) == spec
    own = [("0", "a", "1", "0"), ("1", "b", "2", "0"), ("0", "d", "2", "0")]
    df = spark.createDataFrame([(f"m{g}", *r) for g in range(5) for r in own] + [("other", "1", "b", "2", "1")], MOVES)
    got = {(r.graph, r.k): (int(r.agreed), int(r.spec_only), int(r.model_only)) for r in agreement.by_depth(df, rules, atoms, 2).collect()}
    assert got == {(f"m{g}", k): (k - 1, sum(spec[:k]) - k + 1, 1) for g in range(5) for k in (1, 2)} | {("other", k): (1, sum(spec[:k]) - 1, 0) for k in (1, 2)}
