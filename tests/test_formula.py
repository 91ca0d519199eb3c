import itertools

import pytest
from sparktrail.plans import formula as fm
from sparktrail.plans import temporal

TABLE = {  # trace: F b, G(a->F b), !b W a, !b U a, G(a->!F b), X b
    "ab": "TTTTFT", "ba": "TFFFTF", "a": "FFTTTF", "b": "TTFFTF", "c": "FTTFTF", "": "FFFFFF",
}
RULES = ["F b", "G(a -> F(b))", "!b W a", "!b U a", "G(a -> !F(b))", "X b"]
MORE = ["G(a -> X(b | F c))", "(a U b) W c", "!(F a & G !b)", "a <-> X X b", "F(a & X(b & X c))", "G(a -> (F(b) | F(c)))", "!c W (a | b)", "G F a", "X G a", "!X true"]


def words(n, letters="abc"):
    return [w for k in range(1, n + 1) for w in itertools.product(letters, repeat=k)]


def test_truth_table():
    for trace, want in TABLE.items():
        assert "".join("T" if fm.holds(fm.parse(r), [{x} for x in trace]) else "F" for r in RULES) == want


def test_parse():
    assert fm.parse("!a & b | c -> d") == ("imp", ("or", ("and", ("not", ("atom", "a")), ("atom", "b")), ("atom", "c")), ("atom", "d"))
    assert fm.parse("start(x y) && (n <= 10)") == ("and", ("atom", "start(x y)"), ("atom", "n <= 10"))
    assert fm.parse("a -> b -> c")[2][0] == "imp" and fm.parse("a U b & c")[0] == "and"
    for bad in ("a U b U c", "(a", "a b", "", "f a", "a &", "G", "#"):
        with pytest.raises(fm.FormulaError):
            fm.parse(bad)
    for r in RULES + MORE:
        assert fm.parse(fm.text(fm.parse(r))) == fm.parse(r)


def test_simplify_progress_and_automaton_agree_with_the_definition():
    for rule in RULES + MORE:
        f = fm.parse(rule)
        simple = fm.simplify(fm.core(f))
        delta, accept = fm.automaton(f, ["a", "b", "c", None])
        move = {(s, x): t for s, x, t in delta}
        for w in words(4):
            trace = [{x} for x in w]
            want = fm.holds(f, trace)
            assert fm.holds(simple, trace) == want, (rule, w)
            state = 0
            for x in w:
                state = move[state, x]
            assert accept[state] == want, (rule, w)


def test_obligations_and_synthesis():
    assert fm.obligations(fm.parse("a & !b & F c")) == ({"a"}, {"b"}, {"c"})
    for t in fm.synthesize(fm.parse("G(a -> F b) & F a"), 3):
        assert fm.holds(fm.parse("G(a -> F b) & F a"), t)
    assert len(fm.synthesize(fm.parse("a | !a"), 3, most=5)) == 5 and fm.synthesize(fm.parse("a & !a"), 2) == []


def test_rows_agree_with_the_definition(spark):
    traces = words(4)
    rows = [("".join(w), k, x) for w in traces for k, x in enumerate(w)]
    df = spark.createDataFrame(rows, "id string, pos int, atom string")
    rules = {f"r{i}": r for i, r in enumerate(RULES + MORE)}
    cases = spark.createDataFrame([("".join(w),) for w in traces] + [("",)], "id string")
    got = {r.id: r for r in temporal.verdicts(df, rules, "id", ["pos"], "atom", cases).collect()}
    arrays = spark.createDataFrame([("".join(w), list(w)) for w in traces] + [("", [])], "id string, steps array<string>")
    folded = {r.id: r for r in arrays.select("id", *[temporal.fold(arrays.steps, r).alias(n) for n, r in rules.items()]).collect()}
    for w in [*traces, ()]:
        for name, rule in rules.items():
            want = fm.holds(fm.parse(rule), [{x} for x in w])
            assert got["".join(w)][name] == want == folded["".join(w)][name], (rule, w)
    steps = temporal.at_each_step(df, "a U b", "id", ["pos"], "atom").filter("id = 'aabc'").orderBy("pos").collect()
    assert [r.holds for r in steps] == [True, True, True, False]


def test_audit(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b")], "id int, pos int, atom string")
    got = {r.id: (r.first_failing, r.parse_errors) for r in temporal.audit(df, {"p": "F b", "q": "F a", "bad": "(("}, "id", ["pos"], "atom").collect()}
    assert got == {1: ("bad", 1), 2: ("q", 1)}
