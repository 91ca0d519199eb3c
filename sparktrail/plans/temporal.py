"""Formulas over rows: a case column, an order, and one atom a row.

Templates become one hash aggregate for a whole suite: the first and last position of each atom a
case, whatever the number of rules. Anything else becomes running windows in reverse order, so every
suffix quantifier costs one step a row, and all operators of a formula share one sort a case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import formula as fm


def positions(df: DataFrame, case: str, order: list[str], atom: str, names: list[str]) -> DataFrame:
    """case, then first and last position of each name (columns first_0, last_0, ...), in one aggregate over (order) structs."""
    at = F.struct(*order)
    cols = []
    for k, name in enumerate(names):
        here = F.when(F.col(atom) == name, at)
        cols += [F.min(here).alias(f"first_{k}"), F.max(here).alias(f"last_{k}")]
    return df.groupBy(case).agg(*cols)


def closed(shape: tuple, names: list[str]) -> Column:
    """The verdict of a template over the columns of `positions`."""
    first, last = (lambda a: F.col(f"first_{names.index(a)}")), (lambda a: F.col(f"last_{names.index(a)}"))
    kind = shape[0]
    if kind == "exists":
        return last(shape[1]).isNotNull()
    if kind == "response":
        goals = [last(b) for b in shape[2]]
        return last(shape[1]).isNull() | reduce(lambda x, y: x | y, (F.coalesce(g >= last(shape[1]), F.lit(False)) for g in goals))
    if kind == "precedence":
        opens = [first(a) for a in shape[1]]
        before = reduce(lambda x, y: x | y, (F.coalesce(a <= first(shape[2]), F.lit(False)) for a in opens))
        free = first(shape[2]).isNull()
        if shape[3]:
            return reduce(lambda x, y: x | y, (a.isNotNull() for a in opens)) & (free | before)
        return free | before
    if kind == "absence_after":
        return F.coalesce(last(shape[2]) < first(shape[1]), F.lit(True))
    raise ValueError(kind)


def _windowed(df: DataFrame, f: fm.Formula, case: str, order: list[str], atom: str) -> tuple[DataFrame, str]:
    """Adds a boolean column for the formula at each row; shared subformulas once."""
    back = Window.partitionBy(case).orderBy(*[F.col(c).desc() for c in order])
    running = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if "_r" not in df.columns:
        df = df.withColumn("_r", F.row_number().over(back))
    made: dict[fm.Formula, str] = {}

    def add(name: fm.Formula, value: Column) -> str:
        nonlocal df
        made[name] = f"_f{len(made)}"
        df = df.withColumn(made[name], value)
        return made[name]

    def build(g: fm.Formula) -> str:
        if g in made:
            return made[g]
        op = g[0]
        if op == "atom":
            return add(g, F.coalesce(F.col(atom) == g[1], F.lit(False)))
        if op in ("true", "false"):
            return add(g, F.lit(op == "true"))
        parts = [F.col(build(p)) for p in g[1:]]
        if op == "not":
            return add(g, ~parts[0])
        if op in ("and", "or", "imp", "iff"):
            return add(g, {"and": lambda p, q: p & q, "or": lambda p, q: p | q, "imp": lambda p, q: ~p | q, "iff": lambda p, q: p == q}[op](*parts))
        if op == "X":
            return add(g, F.coalesce(F.lag(parts[0]).over(back), F.lit(False)))
        if op in ("F", "G"):
            return add(g, (F.max if op == "F" else F.min)(parts[0]).over(running))
        p, q = parts
        goal, breach = F.max(F.when(q, F.col("_r"))).over(running), F.max(F.when(~p, F.col("_r"))).over(running)
        reached = goal.isNotNull() & F.coalesce(breach <= goal, F.lit(True))
        return add(g, reached | breach.isNull() if op == "W" else reached)

    column = build(f)
    return df, column


def verdicts(df: DataFrame, rules: dict[str, str], case: str, order: list[str], atom: str, cases: DataFrame | None = None) -> DataFrame:
    """case and one boolean column a rule. `cases` lists cases of which some may have no rows; those satisfy nothing."""
    parsed = {name: fm.parse(text) for name, text in rules.items()}
    shapes = {name: s for name, f in parsed.items() if (s := fm.template(f))}
    others = {name: f for name, f in parsed.items() if name not in shapes}
    rows = df.select(case, *order, F.col(atom).alias("_atom"))
    names = sorted({a for name in shapes for a in fm.atoms(parsed[name])})
    out = positions(rows.filter(F.col(case).isNotNull()), case, order, "_atom", names).select(case, *[closed(s, names).alias(n) for n, s in shapes.items()]) if shapes or not others else None
    if others:
        wide, made = rows.filter(F.col(case).isNotNull()), {}
        for name, f in others.items():
            wide, column = _windowed(wide, f, case, order, "_atom")
            wide = wide.withColumnRenamed(column, f"v_{name}").drop(*[c for c in wide.columns if c.startswith("_f") and c != column])
            made[name] = F.max_by(f"v_{name}", "_r").alias(name)
        general = wide.groupBy(case).agg(*made.values())
        out = out.join(general, case) if out is not None else general
    if cases is not None:
        out = cases.select(case).distinct().join(out, case, "left").select(case, *[F.coalesce(n, F.lit(False)).alias(n) for n in rules])
    return out.select(case, *rules)


def at_each_step(df: DataFrame, rule: str, case: str, order: list[str], atom: str, name: str = "holds") -> DataFrame:
    """The rows with the rule's value at each of them."""
    before = df.columns
    out, column = _windowed(df, fm.parse(rule), case, order, atom)
    return out.select(*before, F.col(column).alias(name))


def fold(steps: Column, rule: str) -> Column:
    """The rule on an array of atoms (one a step, null for none), by one backward fold over the tabulated automaton's inverse.

    For nested formulas on small arrays; long cases take `verdicts`. The empty array is false."""
    f = fm.core(fm.parse(rule))
    parts: list[fm.Formula] = []

    def number(g: fm.Formula) -> int:
        if g not in parts:
            for p in g[1:]:
                if isinstance(p, tuple):
                    number(p)
            parts.append(g)
        return parts.index(g)

    number(f)
    size = len(parts)

    def step(later: Column, atom: Column) -> Column:
        last = F.size(later) == 0
        now: list[Column] = []
        for g in parts:
            k = [parts.index(p) for p in g[1:] if isinstance(p, tuple)]
            then = lambda i, default: F.when(last, F.lit(default)).otherwise(F.get(later, F.lit(i)))
            me, op = parts.index(g), g[0]
            now.append(
                F.coalesce(atom == g[1], F.lit(False)) if op == "atom"
                else F.lit(op == "true") if op in ("true", "false")
                else ~now[k[0]] if op == "not"
                else now[k[0]] & now[k[1]] if op == "and"
                else now[k[0]] | now[k[1]] if op == "or"
                else then(k[0], False) if op == "X"
                else now[k[0]] | then(me, False) if op == "F"
                else now[k[0]] & then(me, True) if op == "G"
                else now[k[1]] | (now[k[0]] & then(me, op == "W"))
            )
        return F.array(*now)

    out = F.aggregate(F.reverse(steps), F.array().cast("array<boolean>"), step)
    return F.coalesce(F.get(out, F.lit(size - 1)), F.lit(False))


def audit(df: DataFrame, rules: dict[str, str], case: str, order: list[str], atom: str) -> DataFrame:
    """The first failing rule of each case, and whether its text could be parsed: case, first_failing, parse_errors."""
    good, bad = {}, []
    for name, text in rules.items():
        try:
            fm.parse(text)
            good[name] = text
        except fm.FormulaError:
            bad.append(name)
    v = verdicts(df, good, case, order, atom)
    fails = [F.when(F.lit(True) if n in bad else ~F.col(n), F.lit(n)) for n in rules]
    return v.select(case, F.coalesce(*fails).alias("first_failing"), F.lit(len(bad)).cast("bigint").alias("parse_errors"))
