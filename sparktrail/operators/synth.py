"""Rules from process graphs. nodes: graph, node, type, name. edges: graph, src, dst, flow, condition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.text import else_guard

#: Node types whose completion is covered by tier P4.
TASKS = ["task", "userTask", "serviceTask", "scriptTask", "manualTask"]
SPLITS = ["exclusiveGateway", "eventBasedGateway"]


def resolve_guards(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the implicit else of each exclusive split: the default flow, else its single flow without a condition."""
    splits = nodes.filter(F.col("type").isin(SPLITS)).select("graph", F.col("node").alias("src"), "default_flow", F.lit(True).alias("_s"))
    df = edges.join(splits, ["graph", "src"], "left")
    by = Window.partitionBy("graph", "src")
    bare = F.sum(F.col("condition").isNull().cast("int")).over(by)
    is_else = F.coalesce("_s", F.lit(False)) & F.when(F.col("default_flow").isNotNull(), F.col("flow") == F.col("default_flow")).otherwise(F.col("condition").isNull() & (bare == 1))
    df = df.withColumn("_e", is_else)
    others = F.array_sort(F.collect_list(F.when(~F.col("_e") & F.col("condition").isNotNull(), F.struct("flow", "condition"))).over(by))
    guard = else_guard(F.transform(others, lambda x: x["condition"]))
    return df.withColumn("condition", F.when(F.col("_e") & (F.size(others) > 0), guard).otherwise(F.col("condition"))).drop("_s", "_e", "default_flow")


def _name(pdf: pd.DataFrame) -> dict[str, str]:
    return {n: str(x or n).replace(" ", "_").replace("\n", "_") for n, x in zip(pdf["node"], pdf["name"], strict=True)}


def properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, tier, ord, formula: P0 no end before a start; P1 precedence, exclusion and co-occurrence; P2 bounded loops; P4 coverage."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        kind, name = dict(zip(a["node"], a["type"], strict=True)), _name(a)
        pairs = list(zip(b["src"], b["dst"], strict=True))
        into, away = graphs.follow(pairs, back=True), graphs.follow(pairs)
        tasks = [n for n in sorted(kind) if "task" in kind[n].lower()]
        starts = [n for n in sorted(kind) if kind[n] == "startEvent"] or [n for n in sorted(kind) if not into.get(n)]
        ends = {n for n in kind if kind[n] == "endEvent"} or {n for n in kind if not away.get(n)}
        rows = [("P0", f"!done({name[n]}) W start({name[n]})") for n in tasks]
        for t in tasks:  # nearest tasks before t, whether a start comes without one, and whether they meet in a parallel join
            before, free, seen, todo, joins = [], False, set(), list(into.get(t, [])), False
            free = not todo
            while todo:
                n = todo.pop(0)
                if n in seen:
                    continue
                seen.add(n)
                if n in tasks:
                    before.append(n)
                    continue
                joins |= kind.get(n) == "parallelGateway" and len(into.get(n, [])) > 1
                free |= n in starts or not into.get(n)
                todo += into.get(n, [])
            if before and not free:
                names = [f"done({name[n]})" for n in sorted(before)]
                rows += [("P1", f"!start({name[t]}) W {x}") for x in names] if joins else [("P1", f"!start({name[t]}) W ({' | '.join(names)})" if len(names) > 1 else f"!start({name[t]}) W {names[0]}")]
        for g in sorted(kind):
            branches = [n for n in away.get(g, []) if n in tasks]
            for i, x in enumerate(branches):
                for y in branches[i + 1 :]:
                    if kind[g] in SPLITS:
                        rows.append(("P1", f"G(start({name[x]}) -> !start({name[y]}))"))
                    elif kind[g] == "parallelGateway":
                        rows += [("P1", f"G({f}({name[x]}) <-> {f}({name[y]}))") for f in ("start", "done")]
        if any(x == y for x, y in pairs) or len(set(graphs.components(kind, pairs).values())) < len(kind):
            rows.append(("P2", "G(start -> F(done))"))
        # a task is on every way if no end can be reached without it; paths aren't listed
        around = lambda t: graphs.reach([s for s in starts if s != t], [(x, y) for x, y in pairs if t not in (x, y)]) & ends
        needed = {t for t in tasks if not around(t) - {t}} if graphs.reach(starts, pairs) & ends else set()
        rows += [("P4", f"F(done({name[t]}))" if t in needed else f"G(start({name[t]}) -> F(done({name[t]})))") for t in tasks if kind[t] in TASKS]
        return pd.DataFrame([(key[0], tier, i, f) for i, (tier, f) in enumerate(rows)], columns=["graph", "tier", "ord", "formula"])

    n, e = nodes.select("graph", "node", "type", "name"), edges.select("graph", "src", "dst")
    return n.groupBy("graph").cogroup(e.groupBy("graph")).applyInPandas(run, "graph string, tier string, ord int, formula string")


def precedence_from_follows(follows: DataFrame) -> DataFrame:
    """src, dst, formula: for atoms with one predecessor only, that one comes first. follows: src, dst."""
    single = follows.groupBy("dst").agg(F.countDistinct("src").alias("_n"), F.min("src").alias("src")).filter("_n = 1 AND src <> dst")
    return single.select("src", "dst", F.concat(F.lit("!"), "dst", F.lit(" W "), "src").alias("formula"))


def coverage_rules(cases: DataFrame, case: str, atom: str) -> DataFrame:
    """atom, formula: F(a) for atoms of every case, else a response from a to itself."""
    total = cases.agg(F.countDistinct(case).alias("_t"))
    seen = cases.groupBy(atom).agg(F.countDistinct(case).alias("_c")).crossJoin(F.broadcast(total))
    return seen.select(F.col(atom).alias("atom"), F.when(F.col("_c") == F.col("_t"), F.concat(F.lit("F("), atom, F.lit(")"))).otherwise(F.concat(F.lit("G("), atom, F.lit(" -> F("), atom, F.lit("))"))).alias("formula"))


def killers(missing: DataFrame) -> DataFrame:
    """formula that tells a mutant from the original: missing has difference (edge, gateway, condition, type, loop), a, b."""
    a, b = F.col("a"), F.col("b")
    rule = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    return missing.withColumn(
        "formula",
        F.when(F.col("difference") == "edge", rule("G(", a, " -> (F(", b, ") | F(error)))")).when(F.col("difference") == "gateway", rule("G(", a, " -> !", b, ")")).when(F.col("difference") == "condition", rule("G(", a, " -> F(", b, "))")).when(F.col("difference") == "type", rule("F(", a, ")")).otherwise(rule("G(", a, " -> !F(", b, "))")),
    )
