"""Guards as Columns against Python's own evaluation of the same text, row by row."""

import pytest
from pyspark.sql import functions as F

from sparktrail.plans import guards

SCHEMA = "a int, b bigint, s string, t array<string>, ok boolean, `odd name` int"
ROWS = [(1, 5, "abc", ["x"], True, 1), (10, -3, "", [], False, 2), (None, None, None, None, None, None), (0, 0, "zzz" * 40_000, ["x", "y"], True, 3), (-7, 3, "Ünï", ["y"], False, 4), (1, 5, "abc", ["x"], True, 1)]
GUARDS = [
    "a > 3", "a >= 1 and b < 5", "not (a == 1 or s == 'abc')", "len(s) > 2", "len(t) == 1", "s in ('abc', None)", "a not in [1, 10]", "a is None", "s is not None and len(s) > 3",
    "0 <= a < 10", "ok", "not ok", "s", "t", "a + b * 2 - 1 > -4", "a % 3 == 2", "a % b == 0", "a is None or a > 0", "a != b", "s + 'x' == 'abcx'", "ok == True", "a > 0 or b > 0",
]


def _plain(text, row):
    try:
        return bool(eval(text, {"len": len}, row))  # noqa: S307
    except (TypeError, ZeroDivisionError):
        return None


def test_like_python(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kinds = dict(df.dtypes)
    got = df.select(*[guards.Guard(g, kinds).column.alias(f"g{i}") for i, g in enumerate(GUARDS)]).collect()
    for row, told in zip(ROWS, got, strict=True):
        names = dict(zip(["a", "b", "s", "t", "ok"], row, strict=False))
        assert {g: told[i] for i, g in enumerate(GUARDS)} == {g: _plain(g, names) for g in GUARDS}


@pytest.mark.parametrize("text", ["a >", "nobody > 1", "a.x > 1", "f(a)", "a in b", "lambda: 1", "a ** 2 > 1", ""])
def test_unknown_guards_are_told(spark, text):
    with pytest.raises(guards.GuardError):
        guards.Guard(text, dict(spark.createDataFrame([], SCHEMA).dtypes))


def test_boundary_and_arms(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    near = guards.boundary(df, ["a > 3", "b in (7, 8)", "s == 'q'", "5 <= a"], "origin")
    made = {r.origin for r in near.collect()}
    assert made == {None, *(f"a={v}" for v in (2, 3, 4, 5, 6)), *(f"b={v}" for v in (6, 7, 8, 9))} and near.count() == len(ROWS) * 10
    assert near.filter("origin = 'a=4'").select(F.collect_set("a")).first()[0] == [4] and near.columns == [*df.columns, "origin"]
    told = {r.guard: r[1:] for r in guards.arms(df, {"low": "a < 3", "never": "a > 50"}).collect()}
    assert told == {"low": (4, 1, 1, True), "never": (0, 5, 1, False)}
    assert guards.arms(near, {"never": "a == 4"}).first().covered
    assert [tuple(r) for r in guards.arms(df.limit(0), {"low": "a < 3"}).collect()] == [("low", 0, 0, 0, False)]
