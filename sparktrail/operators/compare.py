"""Comparison of recorded runs with expected ones. events: run_id, side (actual or expected), pos, event, task, taken, value, exception.

Events are task_entry, task_exit, branch_point, return_value and exception. A run's two sides are compared as sequences of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences

EVENTS = "run_id string, side string, pos int, event string, task string, taken boolean, value string, exception string"
TASKS = ["task_entry", "task_exit"]
#: Least similarity that passes, and how many divergences are told.
PASS, TOLD = 0.95, 5


def without_helpers(events: DataFrame) -> DataFrame:
    """Without the actual side's task events whose task the expected side doesn't know."""
    expected = events.filter((F.col("side") == "expected") & F.col("event").isin(TASKS)).select("run_id", "task").distinct()
    silent = (F.col("side") == "actual") & F.col("event").isin(TASKS)
    named = events.filter(silent).join(expected, ["run_id", "task"], "left_semi").select(events.columns)
    return events.filter(~silent).unionByName(named)


def items(events: DataFrame) -> DataFrame:
    """run_id, side, pos, item, branch: what is compared. In task_only mode branch points go.

    A branch's direction counts only if all branch points of both sides have one, a return value only if both sides returned."""
    events = without_helpers(events)
    branch, back = F.col("event") == "branch_point", F.col("event") == "return_value"
    has = lambda side: F.coalesce(F.bool_or(back & (F.col("side") == side)), F.lit(False))
    whole = events.groupBy("run_id").agg(F.coalesce(F.bool_and(F.when(branch, F.col("taken").isNotNull())), F.lit(True)).alias("_t"), (has("actual") & has("expected")).alias("_b"))
    df = events.join(whole, "run_id").filter(~back | F.col("_b"))
    item = (
        F.when(F.col("event").isin(TASKS), F.concat_ws(":", "event", F.coalesce("task", F.lit(""))))
        .when(branch, F.when(F.col("_t"), F.concat_ws(":", "event", F.col("taken").cast("string"))).otherwise(F.col("event")))
        .when(F.col("event") == "exception", F.concat_ws(":", "event", F.coalesce("exception", F.lit(""))))
        .when(back, F.concat_ws(":", "event", F.coalesce("value", F.lit("None"))))
    )
    return df.select("run_id", "side", "pos", item.alias("item"), branch.alias("branch")).filter("item IS NOT NULL")


def _sequences(parts: DataFrame) -> DataFrame:
    """run_id, mode, actual, expected: both sides' items in order, in both modes, from one pass."""
    side = lambda s, keep: F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == s) & keep, F.struct("pos", "item")))), lambda x: x["item"])
    both = [(mode, F.struct(F.lit(mode).alias("mode"), side("actual", keep).alias("actual"), side("expected", keep).alias("expected"))) for mode, keep in (("strict", F.lit(True)), ("task_only", ~F.col("branch")))]
    return parts.groupBy("run_id").agg(F.array(*[s for _, s in both]).alias("_m")).select("run_id", F.inline("_m"))


def both_modes(events: DataFrame, told: int | None = TOLD) -> DataFrame:
    """run_id, mode, actual, expected, lcs_length, similarity, passed, parted, divergences: every run in strict and in task_only mode.

    A run with nothing to compare passes. `parted` counts all divergences; the last `told` are listed (all for None)."""
    modes = F.explode(F.array(F.lit("strict"), F.lit("task_only"))).alias("mode")
    every = events.select("run_id").distinct().select("run_id", modes)
    seq = every.join(_sequences(items(events)), ["run_id", "mode"], "left")
    empty = F.array().cast("array<string>")
    seq = seq.select("run_id", "mode", *[F.coalesce(c, empty).alias(c) for c in ("actual", "expected")])
    longest = F.greatest(F.size("actual"), F.size("expected"))
    out = seq.withColumn("lcs_length", sequences.common_length(F.col("actual"), F.col("expected")))
    out = out.withColumn("similarity", F.when(longest == 0, 1.0).otherwise(F.col("lcs_length") / longest))
    out = out.withColumn("passed", F.col("similarity") >= PASS).withColumn("parted", F.size("actual") + F.size("expected") - 2 * F.col("lcs_length"))
    return out.withColumn("divergences", sequences.parting_places(F.col("actual"), F.col("expected"), told))


def compared(events: DataFrame, mode: str = "strict", told: int | None = TOLD) -> DataFrame:
    """`both_modes` in one of them."""
    return both_modes(events, told).filter(F.col("mode") == mode).drop("mode")


def divergence_sources(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, source, n: which kinds of events the divergences of failed runs are about. runs: as `compared`."""
    found = runs.filter("NOT passed").select(*by, F.explode("divergences").alias("d"))
    return found.groupBy(*by, F.substring_index(F.col("d.item"), ":", 1).alias("source")).agg(F.count("*").cast("bigint").alias("n"))


def verification(runs: DataFrame, by: list[str], input_key: str) -> DataFrame:
    """The certificate of randomised runs: matching share times share of distinct inputs, runs without a returned value told apart."""
    out = runs.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("runs"), F.count_if("passed").cast("bigint").alias("matching"), F.countDistinct(input_key).cast("bigint").alias("inputs")
    )
    return out.withColumn("confidence", F.col("matching") / F.col("runs") * F.least(F.col("inputs") / F.col("runs"), F.lit(1.0)))


def admission(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, runs, difference_rate, admitted, first_divergent: a variant is admitted if it never differs on the shared inputs.

    pairs: ord, input, calls and returned of both: base_calls, base_return, variant_calls, variant_return."""
    differs = ~(F.col("base_calls").eqNullSafe(F.col("variant_calls")) & F.col("base_return").eqNullSafe(F.col("variant_return")))
    first = F.min(F.when(differs, F.struct("ord", "input", "base_calls", "variant_calls", "base_return", "variant_return")))
    out = pairs.groupBy(*by).agg(F.count("*").cast("bigint").alias("runs"), F.avg(differs.cast("double")).alias("difference_rate"), first.alias("first_divergent"))
    return out.withColumn("admitted", F.col("difference_rate") == 0)


def divergence_class(variant_return: Column, base_return: Column) -> Column:
    """exception if either side raised, else logic."""
    raised = lambda c: F.coalesce(F.startswith(c, F.lit("__exception__:")), F.lit(False))
    return F.when(raised(variant_return) | raised(base_return), "exception").otherwise("logic")


def logic_misses(admitted: DataFrame, scores: DataFrame, threshold: float, key: str = "variant") -> DataFrame:
    """Rejected variants of the logic class that score as sound, with whether only the returned value differs."""
    first = F.col("first_divergent")
    logic = admitted.filter(~F.col("admitted") & (divergence_class(first["variant_return"], first["base_return"]) == "logic"))
    missed = logic.join(scores.filter(F.col("confidence") >= threshold), key)
    return missed.select(key, "confidence", first["base_calls"].eqNullSafe(first["variant_calls"]).alias("same_calls"), first["base_return"].alias("base_return"), first["variant_return"].alias("variant_return"))


def false_alarms(variants: DataFrame, bases: DataFrame, threshold: float) -> DataFrame:
    """n, flagged, controlled, controlled_flagged: false alarms over all variants, and over those whose base isn't flagged itself.

    variants: base_uid, confidence. bases: base_uid, confidence."""
    base = bases.select("base_uid", (F.col("confidence") < threshold).alias("_b"))
    rows = variants.select("base_uid", (F.col("confidence") < threshold).alias("_f")).join(base, "base_uid", "left")
    free = ~F.coalesce(F.col("_b"), F.lit(False))
    return rows.agg(F.count("*").cast("bigint").alias("n"), F.count_if("_f").cast("bigint").alias("flagged"), F.count_if(free).cast("bigint").alias("controlled"), F.count_if(free & F.col("_f")).cast("bigint").alias("controlled_flagged"))
