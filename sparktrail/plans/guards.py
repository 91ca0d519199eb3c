"""Guards of branches as Columns: conditions in Python's notation over the columns of a table, boundary inputs and coverage of arms.

A guard knows names, numbers, strings, booleans, None, the six comparisons (chained ones too), in and not in with listed values, is and
is not with None, and, or, not, len of a string or an array, + - * % and brackets. % takes the divisor's sign, as Python's does.
Whatever else it holds is an error that names it, told before any row is read. A name that is no column is an error as well.

An input for which a guard has no value (a null compared with <, a division by zero, a sum beyond its type) takes neither arm. == and in take null as a value
like any other, as Python does with None; a guard that is a bare value holds where it is not null, zero, empty or false."""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARED = {ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__}


class GuardError(ValueError):
    """A guard that can't become a Column."""


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise GuardError(f"{text!r}: {e.msg}") from e


def _literal(e: ast.expr) -> object:
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub) and isinstance(e.operand, ast.Constant) and isinstance(e.operand.value, int | float):
        return -e.operand.value
    if isinstance(e, ast.Constant) and (e.value is None or isinstance(e.value, str | int | float)):
        return e.value
    raise GuardError(f"no literal: {ast.unparse(e)}")


class Guard:
    """A guard over the columns of a table, whose types it needs to know."""

    def __init__(self, text: str, schema: dict[str, str]):
        self.text, self.schema, self.tree = text, schema, _tree(text)
        self.column = self._truth(self.tree)

    def _kind(self, e: ast.expr) -> str:
        if isinstance(e, ast.Name) and e.id in self.schema:
            t = self.schema[e.id]
            return "array" if t.startswith("array") else t if t in ("string", "boolean") else "number"
        if isinstance(e, ast.Constant):
            return "boolean" if isinstance(e.value, bool) else "string" if isinstance(e.value, str) else "number"
        if isinstance(e, ast.Compare | ast.BoolOp) or (isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not)):
            return "boolean"
        return "number"

    def _value(self, e: ast.expr) -> Column:
        match e:
            case ast.Name(id=name) if name in self.schema:
                return F.col(f"`{name}`")
            case ast.Name(id=name):
                raise GuardError(f"{self.text!r}: no column {name!r}")
            case ast.Constant():
                return F.lit(_literal(e))
            case ast.Compare() | ast.BoolOp() | ast.UnaryOp(op=ast.Not()):
                return self._truth(e)
            case ast.UnaryOp(op=ast.USub()):
                return -self._value(e.operand)
            case ast.Call(func=ast.Name(id="len"), args=[one], keywords=[]):
                return F.array_size(self._value(one)) if self._kind(one) == "array" else F.length(self._value(one))
            case ast.BinOp(op=ast.Add()):
                a, b = self._value(e.left), self._value(e.right)
                return F.concat(a, b) if "string" in (self._kind(e.left), self._kind(e.right)) else F.try_add(a, b)
            case ast.BinOp(op=ast.Sub()):
                return F.try_subtract(self._value(e.left), self._value(e.right))
            case ast.BinOp(op=ast.Mult()):
                return F.try_multiply(self._value(e.left), self._value(e.right))
            case ast.BinOp(op=ast.Mod()):
                a, b = self._value(e.left), F.nullif(self._value(e.right), F.lit(0))
                return (a % b + b) % b
        raise GuardError(f"{self.text!r}: {ast.unparse(e)} is not known")

    def _compared(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        a = self._value(left)
        if isinstance(op, ast.In | ast.NotIn):
            if not isinstance(right, ast.List | ast.Tuple | ast.Set):
                raise GuardError(f"{self.text!r}: in needs listed values")
            values = [_literal(x) for x in right.elts]
            known = [v for v in values if v is not None]
            inside = F.coalesce(a.isin(known), F.lit(False)) if known else F.lit(False)
            inside = inside | a.isNull() if None in values else inside
            return self._made([left], ~inside if isinstance(op, ast.NotIn) else inside)
        b = self._value(right)
        if isinstance(op, ast.Eq | ast.Is):
            return self._made([left, right], a.eqNullSafe(b))
        if isinstance(op, ast.NotEq | ast.IsNot):
            return self._made([left, right], ~a.eqNullSafe(b))
        return COMPARED[type(op)](a, b)

    def _made(self, ends: list[ast.expr], told: Column) -> Column:
        """The same, but no value where an end was computed and has none."""
        for e in ends:
            if not isinstance(e, ast.Name | ast.Constant):
                told = F.when(self._value(e).isNotNull(), told)
        return told

    def _truth(self, e: ast.expr) -> Column:
        match e:
            case ast.BoolOp():
                parts = [self._truth(x) for x in e.values]
                out = parts[-1]
                stop = isinstance(e.op, ast.Or)  # later parts count only where the first don't decide, so a missing value there doesn't matter
                for p in reversed(parts[:-1]):
                    out = F.when(p == F.lit(stop), F.lit(stop)).when(p.isNotNull(), out)
                return out
            case ast.UnaryOp(op=ast.Not()):
                return ~self._truth(e.operand)
            case ast.Compare():
                ends = [e.left, *e.comparators]
                parts = [self._compared(a, op, b) for a, op, b in zip(ends, e.ops, ends[1:], strict=False)]
                out = parts[-1]
                for p in reversed(parts[:-1]):
                    out = F.when(~p, F.lit(False)).when(p, out)
                return out
        v, kind = self._value(e), self._kind(e)
        some = v if kind == "boolean" else F.length(v) > 0 if kind == "string" else F.array_size(v) > 0 if kind == "array" else v != F.lit(0)
        return self._made([e], F.coalesce(some, F.lit(False)))


def literals(guard: str) -> list[tuple[str, object]]:
    """(name, value): literals that a guard compares a name or its length with, in order of their place; those of len carry the name `len(name)`."""
    out = []

    def name(e: ast.expr) -> str | None:
        return ast.unparse(e) if isinstance(e, ast.Name) or (isinstance(e, ast.Call) and ast.unparse(e.func) == "len") else None

    for e in ast.walk(_tree(guard)):
        if isinstance(e, ast.Compare):
            ends = [e.left, *e.comparators]
            for a, b in zip(ends, ends[1:], strict=False):
                for x, y in ((a, b), (b, a)):
                    if name(x):
                        for z in y.elts if isinstance(y, ast.List | ast.Tuple | ast.Set) else [y]:
                            if isinstance(z, ast.Constant | ast.UnaryOp):
                                out.append((name(x), _literal(z)))
    return out


def boundary(df: DataFrame, guards: Iterable[str], key: str) -> DataFrame:
    """The rows of a table, once more for each numeric column that a guard compares with a number, with the number itself and its neighbours in the column's place.

    key: name of a column for the source of a row: null for the row as it was, else `name=value`. One join with the literals of the guards, which are few."""
    kinds = dict(df.dtypes)
    found = {(n, v + step) for g in guards for n, v in literals(g) if kinds.get(n) in ("int", "bigint", "smallint", "tinyint") and isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**62 for step in (-1, 0, 1)}
    near = F.array(F.struct(F.lit(None).cast("string").alias("n"), F.lit(None).cast("bigint").alias("v")), *[F.struct(F.lit(n).alias("n"), F.lit(v).cast("bigint").alias("v")) for n, v in sorted(found)])
    out = df.withColumn("_x", F.explode(near))
    put = [F.when(F.col("_x.n") == c, F.col("_x.v").try_cast(t)).otherwise(F.col(f"`{c}`")).alias(c) if any(n == c for n, _ in found) else F.col(f"`{c}`") for c, t in df.dtypes]
    return out.select(*put, F.concat_ws("=", "_x.n", "_x.v").alias("_k"), "_x").select(*[f"`{c}`" for c in df.columns], F.when(F.col("_x.n").isNotNull(), F.col("_k")).alias(key))


def arms(df: DataFrame, guards: dict[str, str]) -> DataFrame:
    """guard, taken, refused, undecided, covered: how many rows take each arm of each guard, from one pass and one aggregate; covered tells whether both arms are taken."""
    kinds = dict(df.dtypes)
    columns = {name: Guard(text, kinds).column for name, text in guards.items()}
    n = lambda c: F.count_if(c).cast("bigint")
    sums = [F.struct(F.lit(name).alias("guard"), n(c).alias("taken"), n(~c).alias("refused"), n(c.isNull()).alias("undecided")) for name, c in columns.items()]
    out = df.agg(F.array(*sums).alias("a")).select(F.inline("a"))
    return out.withColumn("covered", (F.col("taken") > 0) & (F.col("refused") > 0))
