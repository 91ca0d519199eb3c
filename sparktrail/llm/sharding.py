"""Sharding by minimax contiguous partition of atomic groups.

Groups are rows of equal text, ordered by the text's 64-bit hash; a group never splits. The smallest
capacity for which greedy filling needs no more than `shards` shards is found by binary search, and
the shards are cut where that greedy pass cuts. Law `bytes`: shard sizes are as near equal as
uncut groups allow.

The driver holds no list of groups. It sees sums of groups over ranges of the hash: first 4,096
ranges, then only the ranges in which a cut may fall are opened 256-fold, until every one of them
is a single group. `refine` states why no other range matters; the result is exact.

Slots: rows of a shard are numbered by hash bucket of the document, through a bounded table of
bucket counts and a window inside each bucket.

Defined cases: null text is an empty text of no bytes (size 8, checksum 0); equal texts, repeated
rows and null ids stay together in one shard; a table of fewer groups than shards leaves shards
empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_col

BUCKETS = 1024
FIRST, STEP = 12, 8


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (item counts) of the shards that greedy filling makes, or None if it needs too many."""
    cuts, held = [], 0
    for i, n in enumerate(sizes):
        if n > capacity:
            return None
        if held + n > capacity:
            cuts.append(i)
            held = 0
            if len(cuts) >= shards:
                return None
        held += n
    return cuts


def smallest(sizes: list[int], shards: int) -> int:
    lo, hi = max([*sizes, -(-sum(sizes) // shards)], default=0), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(sizes, mid, shards) is not None else (mid + 1, hi)
    return lo


def refine(items: list[dict], shards: int) -> tuple[list[int], int, list[int]]:
    """Ranges to open; the capacity if they were atomic; its cuts.

    Let C be the exact smallest capacity. It is at most `high`, found with ranges as atoms, and at
    least `low`, the larger of the mean and the largest group. The exact i-th cut lies at or below
    i * high bytes; and it is at or above where filling whole ranges up to `low` arrives, as
    splitting a range can only move greedy cuts on. Only ranges of several groups that overlap
    [that place, i * high] for some i can hold a cut."""
    sizes = [x["n"] for x in items]
    total, high = sum(sizes), smallest(sizes, shards)
    cuts = greedy(sizes, high, shards) or []
    low = max([-(-total // shards), *(x["largest"] for x in items)], default=0)
    starts = [0]
    for n in sizes:
        starts.append(starts[-1] + n)
    lows, at = [], 0
    for _ in range(shards - 1):
        held = 0
        while at < len(sizes) and held + sizes[at] <= low:
            held += sizes[at]
            at += 1
        lows.append(starts[at])
        if at < len(sizes) and held == 0:  # a range of several groups larger than `low`: nothing is known behind it but that it starts here
            lows += [starts[at]] * (shards - 1 - len(lows))
            break
    opened = []
    for k, x in enumerate(items):
        a, b = starts[k], starts[k + 1]
        if x["groups"] > 1 and any(a <= (i + 1) * high and b > lows[i] for i in range(shards - 1)):
            opened.append(k)
    return (opened if high > low else []), high, cuts


def cut_points(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First unsigned-order keys of shards 1, 2, ... and the capacity. groups: key (64 bits, order as signed), n."""

    def ranges(df: DataFrame, bits: int) -> list[dict]:
        cell = F.shiftright("key", 64 - bits)
        rows = df.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max("n").alias("largest"), F.min("key").alias("first"))
        return [r.asDict() | {"bits": bits} for r in rows.orderBy("cell").collect()]

    items = ranges(groups, FIRST)
    while True:
        opened, high, cuts = refine(items, shards)
        if not opened:
            return [items[k]["first"] for k in cuts], high
        new: dict[int, list[dict]] = {}
        for bits in sorted({items[k]["bits"] for k in opened}):
            cells = [items[k]["cell"] for k in opened if items[k]["bits"] == bits]
            inside = groups.join(F.broadcast(groups.sparkSession.createDataFrame([(c,) for c in cells], "c long")), F.shiftright("key", 64 - bits) == F.col("c"), "left_semi")
            finer = min(bits + STEP, 64)
            for r in ranges(inside, finer):
                new.setdefault((bits, r["cell"] >> (finer - bits)), []).append(r)
        chosen = set(opened)
        items = [y for k, x in enumerate(items) for y in (new[(x["bits"], x["cell"])] if k in chosen else [x])]


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row a row."""
    work = Workspace(docs.sparkSession, "sharding")
    text = text_col()
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = work.keep(rows, "rows")
    groups = work.keep(rows.groupBy("key").agg(F.sum("size").alias("n")), "groups")
    points, _ = cut_points(groups, shards)
    number = F.lit(0)
    for p in points:
        number = number + (F.col("key") >= F.lit(p)).cast("int")
    df = rows.withColumn("shard", number.cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id", "key"), F.lit(BUCKETS)).cast("int"))
    counts = df.groupBy("shard", "part").agg(F.count("*").alias("c"))
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("inner", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1)
    df = df.join(counts.drop("c"), ["shard", "part"], "left")
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inner")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
