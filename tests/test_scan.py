"""The associative scan against windows and against plain evaluation."""

import random

import numpy as np
import pytest
from sparktrail.plans import formula as fm
from sparktrail.plans import scan, temporal

RULES = ["a U b", "a W (b | c)", "G(a -> F b)", "X X a", "F(a & X(b U c))", "G a", "!(a U b) | G(c -> X !c)", "true", "a <-> X b"]


@pytest.mark.parametrize("fan", [2, 256])
def test_equal_to_windows(spark, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(1)
    rows = [(0 if k < 400 else rng.choice([None, 1, 2, 3]), k // 2, rng.choice(["a", "b", "c", "d", None]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "case int, at int, atom string, id int").repartition(5)
    for rule in RULES if fan == 2 else RULES[:2]:
        want = {r.id: r.holds for r in temporal.at_each_step(df, rule, "case", ["at", "id"], "atom").collect()}
        got = {r.id: r.holds for r in scan.at_each_step(df, rule, "case", ["at", "id"], "atom", parts=40).collect()}
        assert got == want, rule


def test_automaton_equals_progression():
    rng = random.Random(2)
    for rule in RULES:
        atoms, moves, holds = scan.backward(rule)
        for _ in range(60):
            word = [rng.choice([*"abcd", None]) for _ in range(rng.randint(1, 8))]
            state = 0
            for x in reversed(word):
                state = moves[state][atoms.index(x) if x in atoms else len(atoms)]
            f = fm.core(fm.parse(rule))
            delta, accepting = fm.automaton(f, ["a", "b", "c", "d", None])
            table, q = {(s, x): t for s, x, t in delta}, 0
            for x in word:
                q = table[q, x]
            assert holds[state] == accepting[q], (rule, word)


def test_composition_by_doubling():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        maps, starts = rng.integers(0, 3, (n, 3)).astype(np.int16), rng.random(n) < 0.2
        got, run = scan.composed(maps, starts), None
        for i in range(n):
            run = maps[i] if run is None or starts[i] else maps[i][run]
            assert got[i].tolist() == run.tolist()


def test_empty_one_row_and_clashing_names(spark):
    df = spark.createDataFrame([], "case int, at int, atom string")
    assert scan.at_each_step(df, "F a", "case", ["at"], "atom").count() == 0
    one = spark.createDataFrame([(1, 1, "a", 5, 6)], "case int, at int, atom string, part int, whole int")
    r = scan.at_each_step(one, "F a", "case", ["at"], "atom", "yes").first()
    assert r.yes and r.asDict() == {"case": 1, "at": 1, "atom": "a", "part": 5, "whole": 6, "yes": True}
