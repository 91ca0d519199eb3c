"""Mutants of graphs as rows: every applicable one, numbered; `registry` maps names to DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(sites: DataFrame, operator: str) -> DataFrame:
    return sites.distinct().withColumn("mutant", F.concat(F.lit(f"{operator}__"), F.row_number().over(Window.partitionBy("graph").orderBy("site"))))


def swap_gateway(nodes: DataFrame) -> DataFrame:
    """graph, mutant, node, type: one exclusive gateway made parallel, or the other way."""
    sites = _numbered(nodes.filter(F.col("type").isin("exclusiveGateway", "parallelGateway")).select("graph", F.col("node").alias("site")), "swap-gateway")
    other = F.when(F.col("type") == "exclusiveGateway", "parallelGateway").otherwise("exclusiveGateway")
    return sites.join(nodes, "graph").withColumn("type", F.when(F.col("node") == F.col("site"), other).otherwise(F.col("type"))).drop("site")


def delete_flow(edges: DataFrame) -> DataFrame:
    sites = _numbered(edges.select("graph", F.col("flow").alias("site")), "delete-flow")
    return sites.join(edges, "graph").filter(F.col("flow") != F.col("site")).drop("site")


def retype_task(nodes: DataFrame) -> DataFrame:
    sites = _numbered(nodes.filter(F.lower("type").contains("task")).select("graph", F.col("node").alias("site")), "retype-task")
    other = F.when(F.col("type") == "manualTask", "serviceTask").otherwise("manualTask")
    return sites.join(nodes, "graph").withColumn("type", F.when(F.col("node") == F.col("site"), other).otherwise(F.col("type"))).drop("site")


def invert_condition(edges: DataFrame) -> DataFrame:
    sites = _numbered(edges.filter(F.col("condition").isNotNull()).select("graph", F.col("flow").alias("site")), "invert-condition")
    c = F.col("condition")
    turned = F.when(c.startswith("!(") & c.endswith(")"), F.substr(c, F.lit(3), F.length(c) - 3)).otherwise(F.concat(F.lit("!("), c, F.lit(")")))
    return sites.join(edges, "graph").withColumn("condition", F.when(F.col("flow") == F.col("site"), turned).otherwise(c)).drop("site")


def loop_boundary(atoms: DataFrame) -> DataFrame:
    """graph, atom with the bounds of counting atoms changed: 10 to 5, 20 to 15."""
    counts = F.lower("atom").rlike("count|iteration")
    return atoms.withColumn("atom", F.when(counts, F.regexp_replace(F.regexp_replace("atom", r"\b10\b", "5"), r"\b20\b", "15")).otherwise(F.col("atom")))


registry: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (swap_gateway, delete_flow, retype_task, invert_condition, loop_boundary)}


def behaviour_changes(original: DataFrame, mutant: DataFrame) -> DataFrame:
    """mutant: those whose set of traces differs from the original's. original: trace; mutant: mutant, trace."""
    base = original.select("trace").distinct()
    own = mutant.select("mutant", "trace").distinct()
    known = own.join(base.withColumn("_k", F.lit(1)), "trace", "left")
    counts = known.groupBy("mutant").agg(F.count("*").alias("_n"), F.count("_k").alias("_both"))
    # sets are equal if all of the mutant's traces are known and as many as there are; the total is one number
    total = base.count()
    return counts.filter((F.col("_both") < F.col("_n")) | (F.col("_both") < total)).select("mutant")
