"""Dominators of graphs of any size, as one tree of immediate dominators; rounds of joins, no sets of dominators.

Nodes that lead nowhere dominate nothing else, so they are peeled off first, then those that lead to such nodes only, and so on
while a peel takes a good share of the edges. They come back in turn, each right below the lowest ancestor that its sources share.
For the rest, a spanning tree of the nodes that the roots reach is mended until it is the tree of dominators. A node's dominators always lie
among its ancestors in the tree: at first, as the tree's own way to the node must pass them. In a round each node moves below the
lowest ancestor that it shares with the sources of its edges, for all nodes at once. This never passes a dominator by, and when no
node moves, each node's parent is on every way to it. Shared ancestors come from a table of each node's nearest ancestors, and in
deeper trees of those 1, 2, 4, ... steps up, made by pointer doubling: all tables are linear in the edges, times the logarithm of
the depth. Rounds are as many as moves depend on one another, few on graphs of programs and processes.

All tables of nodes and edges grow with the graph, so they are joined by merges: none is sent to every task through the driver.

Nodes may be of any type with an order, structs of a graph's and a node's name included; null ends are no nodes. Repeated edges
count once. A node that several roots reach by ways with nothing in common has no immediate dominator, like a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _hops, _union, settled

#: Steps of the search of common ancestors between two written tables.
STEPS = 4
#: A node is told its 2 ** LEVELS - 1 nearest ancestors at once.
LEVELS = 5
#: Up to so many edges are mended as they are; of more, nodes are peeled off as long as one edge in SHARE goes.
FEW, SHARE = 1 << 16, 4


def _merged(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return rows.join(other.hint("merge"), on, how)


def _peeled(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges between nodes that lead on, and by peel those into nodes that lead nowhere else."""
    peels, size = [], edges.count()
    while size > FEW:
        onward = edges.select(F.col("src").alias("dst")).distinct().withColumn("on", F.lit(True))
        told = settled(_merged(edges, onward, "dst", "left").select("src", "dst", F.coalesce("on", F.lit(False)).alias("on")))
        left = told.filter("on").count()
        if (size - left) * SHARE < size:
            break
        peels.append(told.filter("NOT on").select("src", "dst"))
        edges, size = told.filter("on").select("src", "dst"), left
    return edges, peels


def _spanning(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, up, depth: a tree of shortest ways; parents are the least ones."""
    kind = roots.schema["node"].dataType
    new = settled(roots.select("node", F.lit(None).cast(kind).alias("up"), F.lit(0).alias("depth")).filter("node IS NOT NULL").distinct())
    seen = [new]
    for hops in _hops():
        layers = [new]
        for _ in range(hops):
            told = _merged(layers[-1].select(F.col("node").alias("src"), "depth"), edges, "src")
            layers.append(told.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("up"), (F.first("depth") + 1).alias("depth")))
        found = _merged(_union(layers[1:]), _union(seen).select("node"), "node", "left_anti")
        first = settled(found.groupBy("node").agg(F.min(F.struct("depth", "up")).alias("x")).select("node", "x.up", "x.depth"))
        if first.isEmpty():
            return settled(_union(seen))
        seen.append(first)
        last = first.agg(F.max("depth")).first()[0]
        new = first.filter(F.col("depth") == last)


def _levels(tree: DataFrame, more: int = 0) -> int:
    """Doublings that reach beyond the root from each node, in a tree up to `more` deeper."""
    return max(1, (int(tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]) + more).bit_length())


def _doubled(tree: DataFrame, levels: int, near: int) -> DataFrame:
    """node, near, far, depth: the node and its ancestors, up to 2 ** near in all; the ancestor 2 ** levels steps up; the steps to it or to the root.

    With more levels than near also lifts: the ancestors 1, 2, 4, ... steps up, null beyond the root."""
    none = F.lit(None).cast(tree.schema["up"].dataType)
    now = tree.select("node", F.array("node").alias("near"), F.col("up").alias("far"), F.col("up").isNotNull().cast("int").alias("depth"), *[F.array("up").alias("lifts")] * (levels > near))
    for k in range(levels):  # what is done stays out of the join: its null key would gather it in one task
        up = now.select(F.col("node").alias("far"), F.col("near").alias("_near"), F.col("far").alias("_far"), F.col("depth").alias("_depth"))
        on, done = _merged(now.filter("far IS NOT NULL"), up, "far"), now.filter("far IS NULL")
        if levels > near:
            on, done = on.withColumn("lifts", F.concat("lifts", F.array("_far"))), done.withColumn("lifts", F.concat("lifts", F.array(none)))
        on = on.withColumn("far", F.col("_far")).withColumn("depth", F.col("depth") + F.col("_depth"))
        now = settled((on.withColumn("near", F.concat("near", "_near")) if k < near else on).select(*now.columns).unionByName(done))
    return now


def _climbed(rows: DataFrame, lifts: DataFrame) -> DataFrame:
    """One step of the search of the lowest common ancestor of a and b: the deeper one goes up, or both to where their ways still differ."""
    for end in ("a", "b"):
        rows = _merged(rows, lifts.select(F.col("node").alias(end), F.col("depth").alias(f"_d{end}"), F.col("lifts").alias(f"_l{end}")), end)
    gap, top = F.col("_da") - F.col("_db"), F.expr("array_max(filter(sequence(0, size(_la) - 1), k -> NOT (_la[k] <=> _lb[k])))")
    rows = rows.select("node", "depth", "a", "b", "c", "open", "_la", "_lb", gap.alias("_gap"), (F.length(F.bin(F.abs(gap))) - 1).cast("int").alias("_k"), top.alias("_top"))
    level = F.col("_gap") == 0

    def moved(end: str, deeper: Column) -> Column:
        go = F.when(deeper, F.get(f"_l{end}", F.col("_k"))).when(level & F.col("_top").isNotNull(), F.get(f"_l{end}", F.col("_top"))).otherwise(F.col(end))
        return F.when(F.col("open"), go).otherwise(F.col(end)).alias(end)

    out = rows.select("node", "depth", moved("a", F.col("_gap") > 0), moved("b", F.col("_gap") < 0), "c", "open", (level & F.col("_top").isNull()).alias("_met"), F.get("_la", F.lit(0)).alias("_up"))
    same, met = F.col("a") == F.col("b"), F.col("_met")
    c = F.when(~F.col("open"), F.col("c")).when(same, F.col("a")).when(met, F.col("_up"))
    return out.select("node", "depth", "a", "b", c.alias("c"), (F.col("open") & ~same & ~met).alias("open"))


def meeting(rows: DataFrame, lifts: DataFrame) -> DataFrame:
    """node, c, rise: the lowest common ancestor of a and b, each its own ancestor, and the steps from b up to it; without one null, and one step beyond
    b's root. rows: node (any key), a, b. lifts: as `_doubled`."""
    for end in ("a", "b"):
        rows = _merged(rows, lifts.select(F.col("node").alias(end), F.col("near").alias(f"_{end}"), F.col("depth").alias(f"_d{end}")), end)
    c = F.get(F.array_intersect("_a", "_b"), F.lit(0))
    rows = rows.select("node", "a", "b", c.alias("c"), F.col("_db").alias("depth"), "_b", (c.isNull() & ((F.col("_da") >= F.size("_a")) | (F.col("_db") >= F.size("_b")))).alias("open"))
    found = lambda x: x.select("node", "c", F.when(F.col("c").isNull(), F.col("depth") + 1).otherwise(F.array_position("_b", F.col("c")) - 1).cast("int").alias("rise"))
    if "lifts" not in lifts.columns:
        return found(rows)
    rows = settled(rows)
    out, rows, done = found(rows.filter("NOT open")), rows.filter("open").drop("_b"), []
    while not rows.isEmpty():
        for _ in range(STEPS):
            rows = _climbed(rows, lifts)
        rows = settled(rows)
        done.append(rows.filter("NOT open").select("node", "c", "depth"))
        rows = rows.filter("open")
    if not done:
        return out
    far, at = _union(done), lifts.select(F.col("node").alias("c"), F.col("depth").alias("_dc"))
    none = far.filter("c IS NULL").select("node", "c", (F.col("depth") + 1).alias("rise"))
    return _union([out, none, _merged(far.filter("c IS NOT NULL"), at, "c").select("node", "c", (F.col("depth") - F.col("_dc")).alias("rise"))])


def _mended(edges: DataFrame, now: DataFrame, levels: int) -> DataFrame:
    """As `_doubled`, of the tree of dominators. now: node, up of a spanning tree."""
    for end in ("src", "dst"):
        edges = _merged(edges, now.select(F.col("node").alias(end)), end, "left_semi")
    joined = edges.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").select("dst")  # any other node is right below its one source
    edges = settled(_merged(edges, joined, "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("a"), F.col("dst").alias("b")))
    while True:
        lifts = _doubled(now, levels, LEVELS)
        moves = settled(meeting(edges, lifts).groupBy("node").agg(F.max(F.struct("rise", "c")).alias("to")).filter("to.rise > 1"))
        if moves.isEmpty():
            return lifts
        now = _merged(lifts, moves, "node", "left").select("node", F.when(F.col("to").isNotNull(), F.col("to.c")).otherwise(F.get("near", F.lit(1))).alias("up"))


def _placed(peel: DataFrame, lifts: DataFrame) -> DataFrame:
    """node, up, near, depth of the nodes of a peel that are reached. lifts: as `_doubled`, of all their sources."""
    told = settled(_merged(peel, lifts.select(F.col("node").alias("src")), "src", "left_semi"))
    first = told.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("b"))
    pairs = _merged(told.withColumnRenamed("dst", "node"), first, "node").filter("src <> b").select("node", F.col("src").alias("a"), "b")
    moves = meeting(pairs, lifts).groupBy("node").agg(F.max(F.struct("rise", "c")).alias("to"))
    new = settled(_merged(first, moves, "node", "left").select("node", F.when(F.col("to").isNotNull(), F.col("to.c")).otherwise(F.col("b")).alias("up")))
    below = _merged(new.filter("up IS NOT NULL"), lifts.select(F.col("node").alias("up"), "near", "depth"), "up")
    below = below.select("node", "up", F.slice(F.concat(F.array("node"), "near"), 1, 2**LEVELS).alias("near"), (F.col("depth") + 1).alias("depth"))
    return settled(below.unionByName(new.filter("up IS NULL").select("node", "up", F.array("node").alias("near"), F.lit(0).alias("depth"))))


def tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, up, depth: the immediate dominator of each node that the roots reach, null for roots. edges: src, dst. roots: node."""
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    edges, peels = _peeled(settled(_merged(edges, roots.select(F.col("node").alias("dst")), "dst", "left_anti")))
    now = _spanning(edges, roots)
    levels = _levels(now, len(peels))  # depths never grow but by peels that come back
    lifts = _mended(edges, now, levels)
    out = [lifts.select("node", F.get("near", F.lit(1)).alias("up"), "depth")]
    for k, peel in enumerate(reversed(peels)):
        if k and "lifts" in lifts.columns:
            lifts = _doubled(_union(out), levels, LEVELS)
        new = _placed(peel, lifts)
        out.append(new.select("node", "up", "depth"))
        if "lifts" not in lifts.columns:
            lifts = lifts.select("node", "near", "depth").unionByName(new.select("node", "near", "depth"))
    return _union(out)


def frontier(edges: DataFrame, dominated: DataFrame) -> DataFrame:
    """node, front: nodes just outside what a node dominates: it dominates a source of an edge into them, and not them, or is them. dominated: as `tree`."""
    up = settled(dominated.select("node", "up", "depth"))
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    ends = _merged(edges, up.select(F.col("node").alias("dst"), F.col("up").alias("stop")), "dst")
    new = settled(ends.select(F.col("src").alias("node"), F.col("dst").alias("front"), "stop").filter("NOT (node <=> stop)"))
    climbed = new.select("node").unionByName(up.select(F.col("up").alias("node"))).distinct()
    above = _doubled(_merged(up, climbed, "node", "left_semi"), min(LEVELS, _levels(up)), LEVELS).select("node", "near", "far")
    seen: list[DataFrame] = []
    while True:  # a walk passes all near ancestors at once, up to the front's own dominator
        at = F.coalesce(F.array_position("near", F.col("stop")), F.lit(0)).cast("int")
        walks = _merged(new, above, "node").select("front", "stop", F.when(at > 0, F.slice("near", 1, at - 1)).otherwise(F.col("near")).alias("near"), F.when(at == 0, F.col("far")).alias("far"))
        found = walks.select(F.explode("near").alias("node"), "front").distinct()
        seen.append(settled(_merged(found, _union(seen), ["node", "front"], "left_anti") if seen else found))
        new = walks.filter("far IS NOT NULL AND NOT (far <=> stop)").select(F.col("far").alias("node"), "front", "stop").distinct()
        new = settled(_merged(new, _union(seen), ["node", "front"], "left_anti"))
        if new.isEmpty():
            return _union(seen)


def above(dominated: DataFrame) -> DataFrame:
    """node, dominators: all dominators of a node from the root on, itself included: as long as the tree is deep, so for reports on shallow graphs."""
    levels = _levels(dominated)
    return _doubled(dominated, levels, levels).select("node", F.reverse("near").alias("dominators"))


def dominates(dominated: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, dominates: whether every way to b passes a, without any list of dominators. pairs: a, b; nodes that no root reaches dominate and are dominated by nothing."""
    pairs = pairs.select("a", "b").distinct()
    met = meeting(pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(F.struct("a", "b").alias("node"), "a", "b"), _doubled(dominated, _levels(dominated), LEVELS))
    met = met.select("node.a", "node.b", F.col("c").eqNullSafe(F.col("node.a")).alias("_is"))
    return _merged(pairs, met, ["a", "b"], "left").select("a", "b", F.coalesce("_is", F.lit(False)).alias("dominates"))
