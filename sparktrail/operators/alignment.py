"""Agreement of a rule suite with a model: trace sets by depth, convergence, gaps, corrections, certificates, and what heals a suite."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graphs
from ..plans import formula as fm

#: Gaps told for each side, and traces from which corrections are made.
GAPS, SOURCES = 5, 10


def agreement(spec: DataFrame, model: DataFrame) -> DataFrame:
    """One row: agreed, spec_only, model_only, fitness, precision, recall, f1 of two sets of traces. Both: trace (array). An empty side counts as 1."""
    a = spec.select("trace").distinct().withColumn("_s", F.lit(True))
    b = model.select("trace").distinct().withColumn("_m", F.lit(True))
    n = lambda c: F.count_if(c).cast("bigint")
    s, m = F.col("_s").isNotNull(), F.col("_m").isNotNull()
    out = a.join(b, "trace", "full").agg(n(s & m).alias("agreed"), n(s & ~m).alias("spec_only"), n(m & ~s).alias("model_only"))
    part = lambda whole: F.when(whole == 0, 1.0).otherwise(F.col("agreed") / whole)
    out = out.withColumns({"precision": part(F.col("agreed") + F.col("spec_only")), "recall": part(F.col("agreed") + F.col("model_only"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumns({"fitness": F.col("recall"), "f1": F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)})


def deepened(spec: Callable[[int], DataFrame], model: Callable[[int], DataFrame], most: int = 20, epsilon: float = 0.001) -> tuple[list[dict], bool]:
    """Agreement at depth 1, 2, ... until two f1 in a row differ by less than epsilon. One row a depth comes to the driver."""
    history: list[dict] = []
    for k in range(1, most + 1):
        history.append({"k": k, **agreement(spec(k), model(k)).first().asDict()})
        if k > 1 and abs(history[-1]["f1"] - history[-2]["f1"]) < epsilon:
            return history, True
    return history, False


def rule_traces(spark: SparkSession, rules: Iterable[str], atoms: list[str]) -> Callable[[int], DataFrame]:
    """Depth to the traces of one atom a step that keep every rule. Only traces that can still be completed are extended; the number of traces may grow with the power of depth."""
    automata = []
    for text in rules:
        f = fm.parse(text)
        names = [*fm.atoms(f)]
        delta, accepting = fm.automaton(f, [*names, None])
        live = graphs.reach([q for q, ok in enumerate(accepting) if ok], [(s, t) for s, _, t in delta], back=True)
        automata.append(({(s, x): t for s, x, t in delta}, accepting, set(names), live))

    def traces(k: int) -> DataFrame:
        now, found = [((), tuple(0 for _ in automata))], []
        for _ in range(k):
            now = [((*trace, a), tuple(delta[q, a if a in names else None] for (delta, _, names, _), q in zip(automata, state, strict=True))) for trace, state in now for a in atoms]
            now = [(trace, state) for trace, state in now if all(q in live for (_, _, _, live), q in zip(automata, state, strict=True))]
            found += [list(t) for t, state in now if all(accepting[q] for (_, accepting, _, _), q in zip(automata, state, strict=True))]
        return spark.createDataFrame([(t,) for t in found], "trace array<string>")

    return traces


def model_traces(moves: DataFrame, initial: str, most_steps: Callable[[int], int] = lambda k: k) -> Callable[[int], DataFrame]:
    """Depth to the label sequences of runs that end in a state without moves, of at most that many steps. moves: src, label (atom), dst."""
    ends = moves.select(F.col("dst").alias("state")).distinct().join(moves.select(F.col("src").alias("state")).distinct(), "state", "left_anti")

    def traces(k: int) -> DataFrame:
        now = moves.filter(F.col("src") == initial).select(F.array("label").alias("trace"), F.col("dst").alias("state"))
        found = now.join(ends, "state", "left_semi").select("trace")
        for _ in range(1, most_steps(k)):
            now = now.join(moves, now.state == moves.src).select(F.concat("trace", F.array("label")).alias("trace"), F.col("dst").alias("state"))
            found = found.unionByName(now.join(ends, "state", "left_semi").select("trace"))
        return found.distinct()

    return traces


def gaps(spec: DataFrame, model: DataFrame, most: int = GAPS) -> DataFrame:
    """kind, trace: traces that only one side has, the first ones of each side in order, for a report."""
    a, b = spec.select("trace").distinct(), model.select("trace").distinct()
    first = lambda df: df.orderBy("trace").limit(most)
    over = first(a.join(b, "trace", "left_anti")).withColumn("kind", F.lit("over_specification"))
    return over.unionByName(first(b.join(a, "trace", "left_anti")).withColumn("kind", F.lit("under_specification"))).select("kind", "trace")


def corrections(spec: DataFrame, model: DataFrame, most: int = SOURCES) -> DataFrame:
    """formula: for each two steps in a row of the first traces that the suite allows and the model hasn't, that the second doesn't come after the first."""
    over = spec.select("trace").distinct().join(model.select("trace").distinct(), "trace", "left_anti").orderBy("trace").limit(most)
    pairs = over.select(F.explode(F.when(F.size("trace") > 1, F.transform(F.slice("trace", 1, F.size("trace") - 1), lambda x, i: F.struct(x.alias("a"), F.get("trace", i + 1).alias("b"))))).alias("p"))
    return pairs.select(killer(F.col("p.a"), F.col("p.b")).alias("formula")).distinct()


def killer(a: Column, b: Column) -> Column:
    return F.concat(F.lit("G("), a, F.lit(" -> !F("), b, F.lit("))"))


def suite_coverage(counts: DataFrame) -> DataFrame:
    """coverage = 0.4 nodes + 0.4 branches + 0.2 depth, to 4 places. counts: nodes, nodes_total, branches, branches_total, depth, bound."""
    part = lambda a, b: F.when(F.col(b) <= 0, 1.0).otherwise(F.col(a) / F.col(b))
    n, b, d = part("nodes", "nodes_total"), part("branches", "branches_total"), part("depth", "bound")
    return counts.withColumns({"node_coverage": F.round(n, 4), "branch_coverage": F.round(b, 4), "depth_coverage": F.round(d, 4), "coverage": F.round(0.4 * n + 0.4 * b + 0.2 * d, 4)})


def certificate(history: list[dict], converged: bool, coverage: float, most: int = 20, epsilon: float = 0.001) -> dict:
    """What a deepening found, for a report."""
    last = history[-1]
    return {
        "alignment": {n: round(last[n], 4) for n in ("f1", "fitness", "precision", "recall")},
        "convergence": {"converged": converged, "k": last["k"] if converged else most, "history": [round(h["f1"], 4) for h in history], "bound_by": "none" if converged else "k_max_reached"},
        "traces": {n: last[n] for n in ("agreed", "spec_only", "model_only")},
        "confidence": round(1 - epsilon if converged else coverage, 4),
    }


def split_certificate(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """graph, splits, resolved, coverage, status, rules: splits are exclusive gateways with two ways out or more; one without conditions is a free choice, so all count as resolved."""
    gates = nodes.filter(F.col("type").isin("exclusiveGateway", "eventBasedGateway")).select("graph", F.col("node").alias("src"))
    ways = edges.join(gates, ["graph", "src"], "left_semi").groupBy("graph", "src").agg(F.count("*").alias("n")).filter("n > 1")
    splits = ways.groupBy("graph").agg(F.count("*").cast("bigint").alias("splits"))
    n = rules.groupBy("graph").agg(F.count("*").cast("bigint").alias("rules"))
    out = nodes.select("graph").distinct().join(splits, "graph", "left").join(n, "graph", "left").fillna(0, ["splits", "rules"])
    return out.withColumns({"resolved": F.col("splits"), "coverage": F.lit(1.0), "status": F.lit("PASS")})


def deceptive(nodes: DataFrame) -> DataFrame:
    """graph, trace: for graphs of two tasks or more with a start and an end: the end right after the start, and the first task after the last one.

    nodes: graph, pos, type, atoms. A task stands for its last atom, a start or end for its first."""
    kind = lambda t: F.col("type") == t
    first, last = F.get("atoms", F.lit(0)), F.element_at("atoms", -1)
    g = nodes.groupBy("graph").agg(
        F.min_by(F.when(kind("startEvent"), first), F.when(kind("startEvent"), F.col("pos"))).alias("s"), F.min_by(F.when(kind("endEvent"), first), F.when(kind("endEvent"), F.col("pos"))).alias("e"),
        F.min_by(F.when(kind("task"), last), F.when(kind("task"), F.col("pos"))).alias("a"), F.max_by(F.when(kind("task"), last), F.when(kind("task"), F.col("pos"))).alias("z"), F.count_if(kind("task")).alias("n"),
    )
    g = g.filter("n > 1 AND s IS NOT NULL AND e IS NOT NULL")
    return g.select("graph", F.explode(F.array(F.array("s", "e"), F.array("z", "a"))).alias("trace"))


def forbidding(traces: DataFrame) -> DataFrame:
    """graph, formula: rules that forbid such traces."""
    return traces.filter(F.size("trace") > 1).select("graph", killer(F.get("trace", F.lit(0)), F.element_at("trace", -1)).alias("formula"))


def healed(suite: dict[str, str], audit: Callable[[dict[str, str]], DataFrame], remedy: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[dict[str, str], list[dict]]:
    """Adds rules for surviving mutants until none survives or the rounds are over.

    audit gives mutant, killed for a suite; remedy gives mutant, formula for survivors. A suite is small: its rules come to the driver."""
    told = []
    for k in range(1, rounds + 1):
        result = audit(suite)
        alive = result.filter("NOT killed")
        new = {f"killer_{k}_{r['mutant']}": r["formula"] for r in remedy(alive).select("mutant", "formula").collect() if r["formula"] and r["formula"] not in suite.values()}
        n = result.agg(F.count("*").alias("n"), F.count_if("killed").alias("k")).first()
        told.append({"round": k, "mutants": n["n"], "killed": n["k"], "added": len(new)})
        if n["k"] == n["n"] or not new:
            break
        suite = suite | new
    return suite, told
