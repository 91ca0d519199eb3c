"""Scalar columns on text, arrays and nested values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def atom_name(c: Column) -> Column:
    """A guard as an atom: other characters become one underscore, none at the ends, and a letter in front."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s.rlike("^[A-Za-z]"), s).otherwise(F.concat(F.lit("g_"), s))


def function_name(c: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^0-9A-Za-z_]+", "_"), "^_+|_+$", ""))
    return F.when(s.rlike("^[a-z]"), s).otherwise(F.concat(F.lit("task_"), s))


def calls(code: Column, stop: list[str]) -> Column:
    """Names called in a text, repeats kept, without those of the stop list."""
    found = F.regexp_extract_all(code, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(stop)) if stop else found


def edge_label(tasks: Column, guard: Column) -> Column:
    """Sorted set of atoms; empty is silent."""
    return F.array_sort(F.array_union(tasks, F.when(guard.isNull(), F.array().cast("array<string>")).otherwise(F.array(guard))))


def guard_kind(guard: Column, known: list[str]) -> Column:
    return (
        F.when(guard.isNull() | F.lower(F.trim(guard)).isin("", "tau", "true"), "silent")
        .when(reduce(lambda a, b: a | b, (guard.rlike(p) for p in known), F.lit(False)), "known")
        .when(guard.rlike(r"^[A-Za-z_]\w*$"), "identifier")
        .otherwise("unknown_unresolved_guard")
    )


def node_text(c: Column) -> Column:
    """Source text of a node without its statement word."""
    s = F.trim(c)
    return F.regexp_replace(F.regexp_replace(s, r"^(?:if|while|elif)\s+(.*?):?$", "$1"), r"^(?:iter\s+|for\s+.+?\s+in\s+)(.*?):?$", "$1")


def else_guard(guards: Column) -> Column:
    return F.array_join(F.transform(guards, lambda g: F.concat(F.lit("!("), g, F.lit(")"))), " && ")


def counterexample(run: Column) -> Column:
    """Task names of a run's atoms, without neighbours that repeat, as one line."""
    names = F.transform(run, lambda a: F.coalesce(F.nullif(F.regexp_extract(a, r"^(?:start|done)\((.*)\)$", 1), F.lit("")), a))
    return F.array_join(F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1))), " → ")


def names_all(line: Column, tasks: Column) -> Column:
    return F.forall(tasks, lambda t: F.contains(line, t))


def fenced(c: Column) -> Column:
    """The first fenced block of a text, or the text."""
    found = F.regexp_extract(c, r"(?s)```[A-Za-z]*\n(.*?)\s*```", 1)
    return F.when(found == "", F.trim(c)).otherwise(F.trim(found))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; one row of the table at a time."""
    row = F.transform(b, lambda _: F.lit(0))

    def step(before: Column, x: Column) -> Column:
        def cell(line: Column, i: Column) -> Column:
            left, up, corner = F.coalesce(F.get(line, i - 1), F.lit(0)), F.get(before, i), F.coalesce(F.get(before, i - 1), F.lit(0))
            return F.when(x == F.get(b, i), corner + 1).otherwise(F.greatest(left, up))

        return F.aggregate(F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>"), lambda line, i: F.concat(line, F.array(cell(line, i))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.coalesce(F.array_max(F.aggregate(a, row, step)), F.lit(0)))


def lcs_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(lcs_length(a, b) / longest)


def task_atoms(node_type: Column, name: Column) -> Column:
    """start and done of a task, or one atom for another node."""
    n = F.regexp_replace(name, r"[ \n]", "_")
    call = lambda f: F.concat(F.lit(f"{f}("), n, F.lit(")"))
    return F.when(F.contains(F.lower(node_type), F.lit("task")), F.array(call("start"), call("done"))).otherwise(F.array(call("node")))
