"""Evaluation: counts, precision and recall, intervals, correlation, thresholds, strata, funnels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; an empty denominator gives 1, and f1 is 0 without both."""
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1")]


def confusion(df: DataFrame, truth: Column, guess: Column, by: list[str] | None = None, strata: bool = False) -> DataFrame:
    """tp, fp, fn, tn by group, or rolled up over the groups."""
    count = lambda c: F.count_if(c).cast("bigint")
    rows = df.rollup(*by) if strata and by else df.groupBy(*(by or []))
    return rows.agg(count(truth & guess).alias("tp"), count(~truth & guess).alias("fp"), count(truth & ~guess).alias("fn"), count(~truth & ~guess).alias("tn"))


def set_scores(gold: DataFrame, found: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """tp, fp, fn a item from two tables of keys."""
    both = gold.select(item, *keys).distinct().withColumn("_g", F.lit(True)).join(found.select(item, *keys).distinct().withColumn("_f", F.lit(True)), [item, *keys], "full")
    return confusion(both, F.coalesce("_g", F.lit(False)), F.coalesce("_f", F.lit(False)), [item]).drop("tn")


def multiset_matches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """matched: rows common to both, repeats counted."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("_x")), b.groupBy(*keys).agg(F.count("*").alias("_y"))
    return x.join(y, keys).agg(F.coalesce(F.sum(F.least("_x", "_y")), F.lit(0)).cast("bigint").alias("matched"))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X >= k): the regularised incomplete beta function I_p(k, n - k + 1), by its continued fraction, so that work doesn't grow with n."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = float(k), float(n - k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    if p < (a + 1) / (a + b + 2):
        return min(1.0, front * _fraction(a, b, p) / a)
    return max(0.0, 1.0 - front * _fraction(b, a, 1 - p) / b)


def _fraction(a: float, b: float, x: float, most: int = 100_000) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, most):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return out
    return out


def exact_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper and Pearson's, by bisection; (0, 1) without observations."""
    if n == 0:
        return 0.0, 1.0

    def solve(rising) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if rising(mid) < 0 else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: binomial_tail(n, k, p) - alpha / 2)
    high = 1.0 if k == n else solve(lambda p: alpha / 2 - (1 - binomial_tail(n, k + 1, p)))
    return low, high


def with_interval(df: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Adds `low` and `high`; for tables of counts, after the aggregate."""

    @F.pandas_udf("low double, high double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_interval(int(a), int(b), alpha) for a, b in zip(ks, ns, strict=True)], columns=["low", "high"])

    return df.withColumn("_i", interval(k, n)).select(*df.columns, "_i.low", "_i.high")


def pearson(x: str, y: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def running_sums(df: DataFrame, column: str, sums: list[str], parts: int = 64) -> DataFrame:
    """df, one row a value of `column`, with the sums of all rows of smaller values as `before_*`, and those of all rows as `all_*`.

    Values fall in ranges between fixed split points; the sums of ranges, `parts` rows, are added up, and each range sorts its own rows only."""
    points = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10_000).alias("p")).first()["p"] or []
    at = F.lit(0)
    for p in sorted(set(points)):
        at = at + (F.col(column) > F.lit(p)).cast("int")
    rows = settled(df.withColumn("_p", at))
    inside = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_p").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier, everything = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranges = ranges.select("_p", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_{c}").over(everything).alias(f"all_{c}") for c in sums])
    out = rows.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(F.broadcast(ranges), "_p")
    return out.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.col(f"_i_{c}") for c in sums}).select(*df.columns, *[f"before_{c}" for c in sums], *[f"all_{c}" for c in sums])


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged, joined from the distinct values, so no task sorts all rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    ranks = running_sums(counts, column, ["_c"]).select(column, (F.col("before__c") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranks, column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(pearson("_rx", "_ry").alias("rho"))


def fisher_z(r: Column, n: Column, z: float = 1.96) -> list[Column]:
    half = z / F.sqrt((n - 3).cast("double"))
    trivial = (n < 4) | (F.abs(r) >= 1)
    return [F.when(trivial, r).otherwise(F.tanh(F.atanh(r) - half)).alias("low"), F.when(trivial, r).otherwise(F.tanh(F.atanh(r) + half)).alias("high")]


def youden(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """tau, j: the least threshold with the greatest J when scores below it are called positive; candidates 0, 1 and all scores."""
    s = df.select(F.col(score).cast("double").alias("s"), positive.alias("p"))
    by = s.groupBy("s").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))
    ends = by.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "s double, pos long, neg long")
    by = by.unionByName(ends).groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    by = running_sums(by, "s", ["pos", "neg"]).select("s", F.col("before_pos").alias("tp"), F.col("before_neg").alias("fp"), F.col("all_pos").alias("np"), F.col("all_neg").alias("nn"))
    j = F.when((F.col("np") == 0) | (F.col("nn") == 0), 0.0).otherwise(F.col("tp") / F.col("np") - F.col("fp") / F.col("nn"))
    return by.withColumn("j", F.round(j, 12)).agg(F.max(F.struct("j", (-F.col("s")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("tau"), F.col("b.j").alias("j"))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, ord, n: rows that pass a stage and all before it, in one pass."""
    sums, so_far = [], F.lit(True)
    for name, passes in stages.items():
        so_far = so_far & F.coalesce(passes, F.lit(False))
        sums.append(F.count_if(so_far).alias(name))
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("ord"), F.lit(name).alias("stage"), F.col(name).cast("bigint").alias("n")) for k, name in enumerate(stages)])
    return one.select(F.inline(rows))


def trial_rates(trials: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes by group; abstentions are left out of the detection denominator."""
    kind = lambda k: F.count_if(F.col("verdict_kind") == k).cast("bigint")
    out = trials.groupBy(*by).agg(F.count("*").cast("bigint").alias("n"), kind("DETECTED").alias("detected"), kind("MISSED_COMPLIANT").alias("missed"), kind("ABSTAINED_INCONCLUSIVE").alias("abstained"), kind("FALSE_ALARM").alias("false_alarms"), kind("CORRECTLY_COMPLIANT").alias("compliant"))
    decided = F.col("detected") + F.col("missed")
    return out.withColumn("detection", F.when(decided > 0, F.col("detected") / decided)).withColumn("abstention", F.col("abstained") / F.col("n"))


def kill_causes(results: DataFrame, by: list[str]) -> DataFrame:
    """killed, by rule, by disconnection, surviving; vacuous where all kills are disconnections. results: killed, by_property (0 or 1)."""
    out = results.groupBy(*by).agg(F.sum("killed").cast("bigint").alias("killed"), F.sum("by_property").cast("bigint").alias("by_property"), F.count_if(F.col("killed") == 0).cast("bigint").alias("survived"))
    return out.withColumn("vacuous", (F.col("killed") > 0) & (F.col("by_property") == 0))


def confidence_v1(runs: DataFrame, by: list[str]) -> DataFrame:
    """Share of matching runs times share of distinct inputs: matched, input."""
    return runs.groupBy(*by).agg((F.avg(F.col("matched").cast("double")) * F.countDistinct("input") / F.count("*")).alias("confidence"))


def compose(v1: Column, v2: Column, v3_ok: Column) -> Column:
    return F.when(v3_ok, 1 - (1 - v1) * (1 - v2)).otherwise(0.0)


def upper_median(values: Column) -> Column:
    kept = F.sort_array(F.collect_list(values))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def coverage(counts: DataFrame) -> DataFrame:
    """Share of covered, at most 1, of total; 1 when there is nothing."""
    return counts.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(F.least(F.col("covered") / F.col("total"), F.lit(1.0))))


def cyclomatic(nodes: Column, edges: Column) -> Column:
    return edges - nodes + 2


def duplicate_names(nodes: DataFrame, by: list[str], name: str, key: str) -> DataFrame:
    """Names that several ids have, with their ids in order."""
    return nodes.groupBy(*by, name).agg(F.array_sort(F.collect_set(key)).alias("ids")).filter(F.size("ids") > 1)


def three_figures(records: DataFrame, threshold: float) -> DataFrame:
    """One row: detection of genuine bugs, specificity on equivalent mutants, false alarms on correct programs, each with its exact interval.

    records: class (buggy, equivalent, correct), confidence. A confidence below the threshold flags."""
    flag = F.col("confidence") < threshold
    n = lambda c: F.count_if(F.col("class") == c).cast("bigint")
    k = lambda c: F.count_if((F.col("class") == c) & flag).cast("bigint")
    kinds = {"genuine": "buggy", "equivalent": "equivalent", "correct": "correct"}
    one = records.agg(*[n(c).alias(f"n_{x}") for x, c in kinds.items()], *[k(c).alias(f"k_{x}") for x, c in kinds.items()])
    for x in kinds:
        one = with_interval(one, f"k_{x}", f"n_{x}").withColumnsRenamed({"low": f"low_{x}", "high": f"high_{x}"})
    rate = lambda x: F.when(F.col(f"n_{x}") > 0, F.col(f"k_{x}") / F.col(f"n_{x}"))
    return one.select(
        rate("genuine").alias("detection"), F.col("low_genuine").alias("detection_low"), F.col("high_genuine").alias("detection_high"), "n_genuine",
        (1 - rate("equivalent")).alias("specificity"), (1 - F.col("high_equivalent")).alias("specificity_low"), (1 - F.col("low_equivalent")).alias("specificity_high"), "n_equivalent",
        rate("correct").alias("false_alarm"), F.col("low_correct").alias("false_alarm_low"), F.col("high_correct").alias("false_alarm_high"), "n_correct",
    )


def flagged_by(records: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, n, flagged, rate: for genuine bugs by operator, or programs by class."""
    out = records.groupBy(*by).agg(F.count("*").cast("bigint").alias("n"), F.count_if(F.col("confidence") < threshold).cast("bigint").alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("n"))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, least, and counts of each value in order, so that the whole distribution is told by its distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").cast("bigint").alias("_n"))
    n = F.sum("_n")
    return counts.groupBy(*by).agg(n.alias("n"), (F.sum(F.col(value) * F.col("_n")) / n).alias("mean"), F.min(value).alias("least"), F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), F.col("_n").alias("n")))).alias("distribution"))


def difference_rate(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, runs, rate: share of runs whose two outcomes differ; two nulls are equal."""
    return pairs.groupBy(*by).agg(F.count("*").cast("bigint").alias("runs"), F.avg((~F.col(a).eqNullSafe(F.col(b))).cast("double")).alias("rate"))


def crosstab(df: DataFrame, keys: list[str], across: str, values: list[str]) -> DataFrame:
    """keys, and a count for each given value of `across`; all values in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(across).eqNullSafe(F.lit(v))).cast("bigint").alias(str(v)) for v in values])


def search_confidence(counts: DataFrame) -> DataFrame:
    """confidence of a search over paths. counts: feasible, paths, iterations, timeouts, solved, edges (arms covered), gateways, both (gateways with both arms covered).

    Feasible share, times the share without timeout, times the share solved; without any solution, half the diversity and 0.3 of the covered arms (four
    count fully) where two arms are covered. At most 0.8 if fewer than half the gateways had both arms, at most 0.75 below two arms."""
    rounds = F.greatest("iterations", F.lit(1))
    solved, diversity = F.col("solved") / rounds, F.when(F.col("gateways") > 0, F.col("both") / F.col("gateways")).otherwise(1.0)
    plain = F.col("feasible") / F.greatest("paths", F.lit(1)) * (1 - F.col("timeouts") / rounds) * solved
    credit = 0.5 * diversity + 0.3 * F.least(F.col("edges") / 4, F.lit(1.0))
    c = F.when((solved == 0) & (F.col("edges") >= 2), F.greatest(plain, credit)).otherwise(plain)
    c = F.when((F.col("gateways") > 0) & (diversity < 0.5), F.least(c, F.lit(0.8))).otherwise(c)
    c = F.when((F.col("edges") < 2) & (c > 0.8), F.least(c, F.lit(0.75))).otherwise(c)
    return counts.withColumns({"diversity": diversity, "confidence": c})


def mutation_operator(diff: DataFrame) -> DataFrame:
    """Adds `operator`: what made a mutant, told from its differences. diff: flows_lost, retyped_gateways, retyped_others, conditions_changed, atoms_changed."""
    rule = F.when(F.col("flows_lost") > 0, "delete-flow").when(F.col("retyped_gateways") > 0, "swap-gateway").when(F.col("retyped_others") > 0, "retype-task")
    return diff.withColumn("operator", rule.when(F.col("conditions_changed") > 0, "invert-condition").when(F.col("atoms_changed") > 0, "loop-boundary").otherwise("unknown"))


def verdicts_by_calls(results: DataFrame, calls: DataFrame, by: str = "variant") -> DataFrame:
    """verdict, n, all_called, some_never_called: whether the tasks of a rule were called at run time, by the two-way match of plain names.

    results: by, verdict, atoms. calls: by, callee. A rule without atoms has neither."""
    from ..functions.text import plain

    r = results.withColumn("_id", F.monotonically_increasing_id())
    own = calls.select(by, plain(F.col("callee")).alias("_c")).distinct()
    a = settled(r.select("_id", by, "verdict", F.explode_outer("atoms").alias("_a")))
    met = a.join(own, by, "left").withColumn("_x", plain(F.col("_a")))
    hit = F.coalesce(F.bool_or(F.contains("_x", "_c") | F.contains("_c", "_x")), F.lit(False))
    each = met.groupBy("_id", "verdict", "_a").agg(hit.alias("_h"))
    rule = each.groupBy("_id", "verdict").agg(F.bool_and(F.when(F.col("_a").isNotNull(), F.col("_h"))).alias("_all"))
    return rule.groupBy("verdict").agg(F.count("*").cast("bigint").alias("n"), F.count_if("_all").cast("bigint").alias("all_called"), F.count_if(~F.col("_all")).cast("bigint").alias("some_never_called"))
