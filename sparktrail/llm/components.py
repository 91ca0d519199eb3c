"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one: those above the node itself (large), or those not above it (small)."""
    pairs = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = pairs.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, work: Workspace, name: str = "cc", most: int = 60) -> DataFrame:
    """a, b: edges between long ids -> node, root: every node that isn't the least of its component, and that least one."""
    now, seen = work.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0"), None
    for k in range(1, most):
        new = work.keep(_step(_step(now, True), False), f"{name}-{k}")
        now = new
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen or sign[0] == 0:
            work.drop(*[f"{name}-{i}" for i in range(k)])
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
    raise RuntimeError("components did not settle")
