"""Gates that sort rows into kept and excluded, always with a reason, and verdict assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers, in the order in which a repeated rule keeps its first place.
TIERS = ["P0", "P1", "P2", "P3", "P4", "synthesized_mutant_killers"]
VACUOUS = r"^\s*G\s*\(\s*start\(([^()]*)\)\s*->\s*F\s*\(\s*done\(\1\)\s*\)\s*\)\s*$"


def tier_order(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)


def gate(properties: DataFrame, policy: DataFrame, by: list[str] | None = None) -> DataFrame:
    """properties(tier, ord, formula, ...) with `reason` (null if kept) and `normalised`. policy: tier, conformance_check.

    Repeats are told by the text of the rule as given: start(a) and done(a) are one atom in `normalised`, but not one rule.

    An unknown tier is an error when the row is read."""
    by = by or []
    known = F.assert_true(tier_order(F.col("tier")) > 0, F.concat(F.lit("unknown tier: "), F.col("tier")))
    df = properties.filter(known.isNull()).join(policy.select("tier", "conformance_check"), "tier", "left")
    blank = F.regexp_replace(F.regexp_replace("formula", r'"[^"]*"|\b(?:start|done|node)\([^()]*\)', "a"), r"<->|->", "#")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("formula", r"\b(?:start|done)\(([^()]*)\)", '"$1"'), "&&", "&"), r"\|\|", "|")
    df = df.withColumn("normalised", plain)
    reason = (
        F.when(~F.coalesce("conformance_check", F.lit(False)), F.lit("tier is not checked"))
        .when(F.col("formula").rlike(r"\bnode\("), "node atom")
        .when(F.col("formula").rlike(VACUOUS), "vacuous conditional")
        .when(blank.rlike(r"<=|>=|==|!=|<|>"), "comparison")
    )
    df = df.withColumn("reason", reason)
    place = Window.partitionBy(*by, "formula", F.col("reason").isNull()).orderBy(tier_order(F.col("tier")), "ord")
    first = F.first("tier").over(place)
    twice = F.when(F.row_number().over(place) > 1, F.when(first == F.col("tier"), F.lit("repeated in tier")).otherwise(F.concat(F.lit("repeated from "), first)))
    return df.withColumn("reason", F.coalesce("reason", twice)).drop("conformance_check")


def atom_gate(rules: DataFrame, known: DataFrame) -> DataFrame:
    """rules(rule, atoms) with `unmatched` and verdict INCONCLUSIVE if an atom is unknown. known: atom."""
    need = rules.select("rule", F.explode(F.array_distinct("atoms")).alias("atom")).distinct()
    gaps = need.join(known.select("atom").distinct(), "atom", "left_anti").groupBy("rule").agg(F.array_sort(F.collect_set("atom")).alias("unmatched"))
    out = rules.join(gaps, "rule", "left").withColumn("unmatched", F.coalesce("unmatched", F.array().cast("array<string>")))
    return out.withColumn("verdict", F.when(F.size("unmatched") > 0, "INCONCLUSIVE"))


def overall(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """FAIL if any violation, else PASS if any compliance, else INCONCLUSIVE; errors count as neither."""
    has = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    return verdicts.groupBy(*by).agg(F.when(has("VIOLATION"), "FAIL").when(has("COMPLIANT"), "PASS").otherwise("INCONCLUSIVE").alias("overall"))


def quality_gate(systems: DataFrame, least: float = 0.95) -> DataFrame:
    """Adds `reason` to systems that abort or resolve too few guards: aborted, guard_success_rate."""
    return systems.withColumn("reason", F.when(F.coalesce("aborted", F.lit(False)), "aborted").when(F.col("guard_success_rate") < least, "guards unresolved"))


def coverage_gate(counts: DataFrame, least: float = 1.0) -> DataFrame:
    return counts.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(F.col("mapped") / F.col("total"))).withColumn("passed", F.col("coverage") >= least)


def screening(flags: DataFrame, stages: list[str]) -> DataFrame:
    """The first stage a row fails, or `pass`: one boolean column a stage, in order."""
    return flags.withColumn("outcome", F.coalesce(*[F.when(~F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in stages], F.lit("pass")))
