"""Agreement of a rule suite with many models by depth, from counts of traces: no trace is listed.

Traces have one atom a step. A model is determinised as it is read: a row holds the set of states that some traces of one length
lead to, the states of the suite's automata after them, and how many such traces there are. A step is a join with the moves and one
aggregate that adds up the counts of equal rows, so work follows the pairs of states, not the traces, whose number grows with
the power of the depth. Traces that the model hasn't are not followed: those of the suite are as many for every model, and are counted once.
Equal models are worked on once. Counts are exact to 38 digits; beyond, the sum is null.

Defined cases: repeated moves count once; silent moves (null labels) and moves with a null end are ignored, as are other columns; a
model without a move from its initial state has no trace; an atom that only the model knows is never allowed by the suite; an empty suite
allows every trace; a suite that allows nothing, or no model, leaves zeros, or no rows."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs as plain
from ..plans import formula as fm
from .graph import settled
from .systems import alike, told

COUNT = "decimal(38,0)"


class Suite:
    """The automata of some rules as lookups in literal arrays; their size depends on the rules alone."""

    def __init__(self, rules: Iterable[str], atoms: list[str]):
        self.atoms, self.rules = atoms, []
        for text in rules:
            f = fm.parse(text)
            names = [*fm.atoms(f)]
            delta, accepting = fm.automaton(f, [*names, None])
            to = {(s, x): t for s, x, t in delta}
            live = plain.reach([q for q, ok in enumerate(accepting) if ok], [(s, t) for s, _, t in delta], back=True)
            table = [[to[q, a if a in names else None] for a in atoms] for q in range(len(accepting))]
            self.rules.append((table, [*map(bool, accepting)], live))

    def counts(self, most: int) -> list[int]:
        """How many traces of 1, 2, ... `most` of the atoms keep every rule: one sum a step over the states of the rules' automata together."""
        now, out = Counter({(0,) * len(self.rules): 1}), []
        for _ in range(most):
            new: Counter = Counter()
            for states, n in now.items():
                for at in range(len(self.atoms)):
                    to = tuple(table[q][at] for q, (table, _, _) in zip(states, self.rules, strict=True))
                    if all(t in live for t, (_, _, live) in zip(to, self.rules, strict=True)):
                        new[to] += n
            now = new
            out.append(sum(n for states, n in now.items() if all(ok[q] for q, (_, ok, _) in zip(states, self.rules, strict=True))))
        return out

    def start(self) -> Column:
        return F.array(*[F.lit(0) for _ in self.rules]).cast("array<int>")

    def after(self, states: Column, letter: Column) -> Column:
        """The states after one more letter; null if the suite can't be kept any more, or doesn't know the letter."""
        at = F.array_position(F.array(*map(F.lit, self.atoms)).cast("array<string>"), letter) - 1
        out = []
        for i, (table, _, live) in enumerate(self.rules):
            flat = F.array(*[F.lit(t if t in live else None).cast("int") for row in table for t in row])
            out.append(F.get(flat, (F.get(states, F.lit(i)) * len(self.atoms) + at).cast("int")))
        new = F.array(*out).cast("array<int>")
        return F.when((at >= 0) & states.isNotNull() & ~F.exists(new, lambda q: q.isNull()), new)

    def accepts(self, states: Column) -> Column:
        ok = F.lit(True)
        for i, (_, accepting, _) in enumerate(self.rules):
            ok = ok & F.get(F.array(*map(F.lit, accepting)), F.get(states, F.lit(i)))
        return F.coalesce(states.isNotNull() & ok, F.lit(False))


def by_depth(moves: DataFrame, rules: Iterable[str], atoms: list[str], most: int = 20) -> DataFrame:
    """graph, k, agreed, spec_only, model_only, fitness, precision, recall, f1: traces of at most k steps, for each k up to `most`.

    moves: graph, src, label, dst, initial (the same in all rows of a graph). A model's traces end in a state without moves; the suite's are those of `atoms`
    that keep every rule. An empty side counts as 1."""
    suite = Suite(rules, list(dict.fromkeys(atoms)))
    moves = moves.filter("graph IS NOT NULL AND src IS NOT NULL AND label IS NOT NULL AND dst IS NOT NULL")
    names, rows = alike(moves.select("graph", "src", F.array("label").alias("label"), "dst", "initial"), "graph", "initial")
    moves = rows.select(F.col("sys").alias("graph"), "src", F.get("label", F.lit(0)).alias("label"), "dst", "initial")
    busy = moves.select("graph", F.col("src").alias("dst"), F.lit(True).alias("_b")).distinct()
    now = moves.groupBy("graph").agg(F.min("initial").alias("i")).select("graph", F.array(F.struct(F.col("i").alias("state"), F.lit(False).alias("end"))).alias("s"), suite.start().alias("q"), F.lit(1).cast(COUNT).alias("n"))
    every = moves.select("graph").distinct()
    moves = settled(moves.join(busy, ["graph", "dst"], "left").select("graph", "src", "label", F.struct(F.col("dst").alias("state"), F.col("_b").isNull().alias("end")).alias("to")))
    levels = []
    for k in range(1, most + 1):
        met = now.select("graph", "s", "q", "n", F.explode("s.state").alias("src")).join(moves.hint("merge"), ["graph", "src"])
        step = met.groupBy("graph", "s", "q", "n", "label").agg(F.array_sort(F.collect_set("to")).alias("s2"))
        step = step.select("graph", F.col("s2").alias("s"), suite.after(F.col("q"), F.col("label")).alias("q"), "n")
        now = settled(step.groupBy("graph", "s", "q").agg(F.sum("n").cast(COUNT).alias("n")))
        model, spec = F.exists("s", lambda x: x["end"]), suite.accepts(F.col("q"))
        add = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast(COUNT)
        levels.append(now.groupBy("graph").agg(add(model & spec).alias("agreed"), add(model & ~spec).alias("model_only")).withColumn("k", F.lit(k)))
    every = every.withColumn("k", F.explode(F.array(*map(F.lit, range(1, most + 1)))))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    so_far = Window.partitionBy("graph").orderBy("k")  # at most `most` rows a graph
    out = every.join(out, ["graph", "k"], "left").select("graph", "k", *[F.sum(F.coalesce(c, F.lit(0).cast(COUNT))).over(so_far).cast(COUNT).alias(c) for c in ("agreed", "model_only")])
    allowed = [n if n < 10**38 else None for n in itertools.accumulate(suite.counts(most))]
    total = F.get(F.array(*[F.lit(None if n is None else Decimal(n)).cast(COUNT) for n in allowed]), F.col("k") - 1)
    out = out.select("graph", "k", "agreed", (total - F.col("agreed")).cast(COUNT).alias("spec_only"), "model_only")
    out = told(names, settled(out.withColumnRenamed("graph", "sys")), "graph")
    share = lambda other: F.when(F.col("agreed") + F.col(other) == 0, 1.0).otherwise(F.col("agreed").cast("double") / (F.col("agreed") + F.col(other)).cast("double"))
    out = out.withColumns({"precision": share("spec_only"), "recall": share("model_only")})
    both = F.col("precision") + F.col("recall")
    return out.withColumns({"fitness": F.col("recall"), "f1": F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)})


def converged(history: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """graph, converged, k, f1: the first k above 1 whose f1 differs from the one before by less than epsilon, else the last k. history: as `by_depth`."""
    by = Window.partitionBy("graph").orderBy("k")
    near = F.coalesce(F.abs(F.col("f1") - F.lag("f1").over(by)) < epsilon, F.lit(False))
    out = history.select("graph", "k", "f1", near.alias("near")).groupBy("graph").agg(F.bool_or("near").alias("converged"), F.min(F.when(F.col("near"), F.struct("k", "f1"))).alias("a"), F.max(F.struct("k", "f1")).alias("z"))
    return out.select("graph", "converged", F.coalesce("a.k", "z.k").alias("k"), F.coalesce("a.f1", "z.f1").alias("f1"))
