"""Traces as rows (case, order, atom): sequences, neighbours, stutter, variants, splits and step mutants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequences(df: DataFrame, case: str, order: list[str], atom: str) -> DataFrame:
    """case, steps: the atoms of a case in order."""
    n = len(order)
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(atom).alias("_a")))), lambda x: x["_a"])
    assert n
    return df.groupBy(case).agg(steps.alias("steps"))


def numbered(df: DataFrame, case: str, order: list[str]) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(case).orderBy(*order)).cast("bigint"))


def directly_follows(df: DataFrame, case: str, order: list[str], atom: str) -> DataFrame:
    """src, dst, n."""
    by = Window.partitionBy(case).orderBy(*order)
    pairs = df.select(F.col(atom).alias("src"), F.lead(atom).over(by).alias("dst"))
    return pairs.filter(F.col("dst").isNotNull()).groupBy("src", "dst").agg(F.count("*").cast("bigint").alias("n"))


def destutter(df: DataFrame, case: str, order: list[str], atom: str) -> DataFrame:
    """Rows whose atom differs from the one before in their case."""
    before = F.lag(atom).over(Window.partitionBy(case).orderBy(*order))
    return df.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col(atom))).drop("_b")


def variants(df: DataFrame, case: str, order: list[str], atom: str) -> DataFrame:
    """variant, n_cases, representative (least case), singleton."""
    lines = sequences(df, case, order, atom).select(case, F.array_join("steps", ">").alias("variant"))
    out = lines.groupBy("variant").agg(F.count("*").cast("bigint").alias("n_cases"), F.min(case).alias("representative"))
    return out.withColumn("singleton", F.col("n_cases") == 1)


def stratified_split(df: DataFrame, key: str, stratum: str, seed: str) -> DataFrame:
    """Adds `calibration`: the first half (rounded down) of each stratum by a seeded hash."""
    # hashes fall in 256 buckets by their first byte; bucket counts are added up, so no task has to sort a whole stratum
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_k", F.substring("_h", 1, 2))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(stratum, "_k").orderBy("_h", key)))
    sizes = rows.groupBy(F.col(stratum).alias("_s"), F.col("_k").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_s")).alias("_all"))
    rows = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_b")))
    return rows.withColumn("calibration", F.col("_before") + F.col("_in") <= F.floor(F.col("_all") / 2)).select(*df.columns, "calibration")


def drop_step(steps: DataFrame, case: str, atom: str) -> DataFrame:
    """One mutant for each step: case, mutant, pos, atom. Input: case, pos (from 1), atom."""
    at = steps.select(case, F.col("pos").alias("mutant"))
    out = steps.join(at, case).filter(F.col("pos") != F.col("mutant"))
    return out.select(case, "mutant", (F.col("pos") - F.when(F.col("pos") > F.col("mutant"), 1).otherwise(0)).alias("pos"), atom)


def swap_adjacent(steps: DataFrame, case: str, atom: str) -> DataFrame:
    """One mutant for each pair of unequal neighbours: case, mutant, pos, atom."""
    by = Window.partitionBy(case).orderBy("pos")
    at = steps.withColumn("_n", F.lead(atom).over(by)).filter(F.col("_n") != F.col(atom)).select(case, F.col("pos").alias("mutant"))
    k = F.col("mutant")
    return steps.join(at, case).select(case, "mutant", F.when(F.col("pos") == k, k + 1).when(F.col("pos") == k + 1, k).otherwise(F.col("pos")).alias("pos"), atom)


def state_changes(df: DataFrame, case: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, with that one as `before`."""
    out = df.withColumn("before", F.lag(value).over(Window.partitionBy(case).orderBy(*order)))
    return out.filter(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def expected_only(events: DataFrame, expected: DataFrame, task: str = "task") -> DataFrame:
    """Events without task events whose task isn't expected; events without a task stay."""
    named = events.filter(F.col(task).isNotNull()).join(expected.select(task).distinct(), task, "left_semi")
    return events.filter(F.col(task).isNull()).unionByName(named.select(events.columns))


def branch_decisions(events: DataFrame, arms: DataFrame) -> DataFrame:
    """Which arm a branch line took, from the line that follows it: arms has line, true_line, false_line."""
    by = Window.partitionBy("run_id").orderBy("pos")
    out = events.withColumn("next_line", F.lead("line").over(by)).join(arms, "line")
    return out.withColumn("taken", F.when(F.col("next_line") == F.col("true_line"), True).when(F.col("next_line") == F.col("false_line"), False))


def loop_iterations(events: DataFrame) -> DataFrame:
    """Numbers the visits of a line within a run."""
    return events.withColumn("iteration", F.row_number().over(Window.partitionBy("run_id", "line").orderBy("pos")))


def optional_fields(events: DataFrame, fields: list[str]) -> DataFrame:
    """Sets a field to null unless both sides of a run have it throughout; sides in `side`."""
    by = Window.partitionBy("run_id")
    for c in fields:
        both = (F.size(F.collect_set(F.when(F.col(c).isNotNull(), F.col("side"))).over(by)) == 2)
        events = events.withColumn(c, F.when(both, F.col(c)))
    return events
