"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. Together they take as many words
as there are; a source stops at `most` times its size and its excess is shared out again by weight.
With sources in rising order of cap / weight the capped ones come first, so one pass of running sums
finds the level at which resharing ends.

A source's share of time t in [0, 1] is target * (1 + tilt * (2t - 1)): tilts of -1, 0 and 1, in
turn by rank, fade a source out, keep it level or fade it in. Its integral is the cumulative demand
target * (t + tilt * (t*t - t)), which is inverted in closed form at the middle of each document's
words to get the document's `position`; rows are range-sorted by it.

Within a source documents are ordered by a hash of their id. A document takes
floor(rate * end) - floor(rate * start) words, where start and end are running sums of sizes, so a
source's sum is its target to within one word and no document exceeds `most` times its size.
Running sums go by hash buckets: a bounded table of bucket sums, then a window inside each bucket.
That leaves no task with all rows of a source.

Defined cases: null text has size 0; a source of size 0 gets target 0; repeated rows are placed one
after the other; an empty table gives an empty result; other columns are ignored by `mix` and
passed on by `curriculum`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_col

#: Hash buckets a source; its bucket sums are this many rows at most.
BUCKETS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> rank, weight and target too. One row a source, in one task."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1))
    df = df.withColumns({"cap": most * F.col("source_size"), "total": F.sum("source_size").over(everything)})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumns({"taken_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_left": F.sum("weight").over(onward)})
    level = (F.col("total") - F.col("taken_before")) / F.col("weight_left")
    df = df.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(everything))
    target = F.least(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double"))
    return df.select("source", "source_size", "rank", "weight", target.alias("target"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, position and tie, range-sorted by position."""
    work = Workspace(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", F.regexp_count(text_col(), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"), F.xxhash64(F.lit(17), "doc_id").alias("order"), F.xxhash64(text_col()).alias("tie"))
    sized = work.keep(sized.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "order", "tie"), F.lit(BUCKETS)).cast("int")), "sized")
    sources = work.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.select(F.col("source").alias("s1"), F.col("part").alias("p1"), "base")
    named = sources.withColumnRenamed("source", "s2")
    # bucket rows are source rows times 1024 at most: join the sources to them, not to the documents
    sums = sums.join(named, _same("s1", "s2"), "left").drop("s2")
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = sized.withColumn("inner", F.sum("size").over(inside))
    df = df.join(sums, _same("source", "s1") & (F.col("part") == F.col("p1")), "left")
    end = F.col("base") + F.col("inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # at the full rate products are whole; below it rounding may not lift a document over its limit
    upto = F.when(F.col("target") >= most * F.col("source_size"), most * end).otherwise(F.floor(rate * end))
    start = F.when(F.col("target") >= most * F.col("source_size"), most * (end - F.col("size"))).otherwise(F.floor(rate * (end - F.col("size"))))
    df = df.withColumn("taken", F.least(upto - start, most * F.col("size")).cast("bigint"))
    # whole documents for a training run: all of them floor(rate) times, and the first ones in order once more
    whole = F.floor(rate)
    df = df.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(whole + (end - F.col("size") / 2.0 <= (rate - whole) * F.col("source_size")).cast("int")).cast("int"))
    tilt = F.pmod("rank", F.lit(3)) - 1
    q = F.when(F.col("source_size") > 0, (end - F.col("size") / 2.0) / F.col("source_size")).otherwise(0.0)
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * q)
    t = F.when(tilt == 0, q).otherwise((root - (1 - tilt)) / (2 * tilt))
    df = df.withColumn("position", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)).cast("double"))
    return df.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "tie").orderBy("position", "doc_id", "tie")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


def curriculum(docs: DataFrame) -> DataFrame:
    """Whole documents, as often as the mix takes them, in training order; columns as given.

    A source's documents come floor(rate) times each, and those first in its order once more, so that its words are
    its target to within half a document. Documents of no words stay once."""
    work = Workspace(docs.sparkSession, "mixing-order")
    # repeated rows are placed alike, as the first of them
    plan = mix(docs).groupBy("doc_id", "source", "tie").agg(F.max("copies").alias("_n"), F.min("position").alias("position"))
    plan = work.keep(plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("tie").alias("_x"), "_n", "position"), "plan")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", F.xxhash64(text_col()).alias("_t"))
    rows = rows.join(plan, _same("doc_id", "_d") & _same("source", "_s") & (F.col("_t") == F.col("_x")), "inner").filter("_n > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    # repeats of a document are spread over the rest of the run
    rows = rows.withColumn("_at", F.col("position") + (F.col("_copy") - 1) * (1 - F.col("position")) / F.col("_n"))
    rows = rows.orderBy("_at", "doc_id", "_copy")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
