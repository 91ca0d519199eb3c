"""Graphs as edge rows: distributed loops for one large graph, and a task a graph for many small ones.

The loops cut lineage with tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import bisect
import itertools
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import graphs
from ..sources.tables import shared_dir


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read again; the table goes at the end of the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """root, node, depth: nodes by least number of steps, of at most `most` if given. edges: src, dst. roots: node. One join a level, on new pairs only, until there are none."""
    edges = settled(edges.select("src", "dst").distinct())
    new = settled(roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("bigint").alias("depth")).distinct())
    seen = [new]
    for k in itertools.count(1) if most is None else range(1, most + 1):
        step = new.join(edges.hint("merge"), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(k).cast("bigint").alias("depth")).distinct()
        new = settled(step.join(_union(seen).hint("merge"), ["root", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = [settled(_union([*seen, new]))] if len(seen) == 6 else [*seen, new]
    return _union(seen)


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst: pairs joined by one step or more."""
    edges = edges.select("src", "dst").distinct()
    out = reachable(edges, edges.select(F.col("dst").alias("node")), most).select(F.col("root").alias("via"), "node")
    return edges.select("src", F.col("dst").alias("via")).join(out, "via").select("src", F.col("node").alias("dst")).distinct()


#: Steps of a loop between two written tables: one at first, twice as many each time, up to the last.
HOPS = [1, 2, 4, 8]


def _hops() -> Iterator[int]:
    return itertools.chain(HOPS, itertools.repeat(HOPS[-1]))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def spread(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: what the starts (node) reach, themselves included. Each node is met once, whatever the number of starts."""
    new = settled(starts.select("node").distinct())
    if new.isEmpty():
        return new
    edges = settled(edges.select("src", "dst").distinct())
    seen = [new]
    for hops in _hops():
        layers = [new]
        for _ in range(hops):
            layers.append(layers[-1].join(edges.hint("merge"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct())
        new = settled(_union(layers[1:]).distinct().join(_union(seen).hint("merge"), "node", "left_anti"))
        if new.isEmpty():
            return _union(seen)
        seen.append(new)


def long_walk_ends(edges: DataFrame) -> DataFrame:
    """node: where walks of any length end: a walk one step longer ends in some of the same nodes, so this is done when none goes."""
    now, size = edges.select(F.col("src").alias("node")).distinct(), None
    for hops in _hops():
        for _ in range(hops):
            now = now.join(edges.hint("merge"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        now = settled(now)
        left = now.count()
        if left in (0, size):
            return now
        size = left


def _on_long_walks(edges: DataFrame) -> DataFrame:
    """Edges from nodes where walks of any length end."""
    return edges.join(long_walk_ends(edges).withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").select("src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle or between cycles: nodes without a way in or without a way out go, again and again."""
    flip = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead = settled(_on_long_walks(edges))
    return ahead if ahead.isEmpty() else settled(flip(_on_long_walks(flip(ahead))))


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches each."""
    stay = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    both = settled(edges.select("src", "dst").unionByName(stay.select("src", F.col("src").alias("dst"))))
    now = stay.select(F.col("src").alias("node"), F.col("src").alias("colour"))
    for hops in _hops():
        new = now.withColumnRenamed("colour", "was")
        for k in range(hops):
            told = new.join(both.hint("merge"), F.col("node") == F.col("src"))
            colour = F.col("was") if k == 0 else F.col("colour")
            own = F.max(F.when(F.col("src") == F.col("dst"), F.col("was"))).alias("was")
            new = told.groupBy(F.col("dst").alias("node")).agg(F.min(colour).alias("colour"), own)
        new = settled(new)
        now = new.select("node", "colour")
        if new.filter("colour < was").isEmpty():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (least member), size, cyclic. All tables are linear in the edges.

    Nodes that no cycle can pass are trimmed. Each node takes the colour of the least node that reaches it; that node's
    component is what reaches it back inside its colour. Edges between colours and of finished components go, and the rest
    is done again. Nodes may be of any type with an order; a null end is no node."""
    edges = settled(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    done: list[DataFrame] = []
    left = edges.filter("src <> dst")
    while not left.isEmpty() and not (left := _trimmed(left)).isEmpty():
        colours = _coloured(left)
        ends = [colours.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}")) for end in ("src", "dst")]
        inside = settled(left.join(ends[0].hint("merge"), "src").join(ends[1].hint("merge"), "dst").filter("_src = _dst").select("src", "dst", F.col("_src").alias("colour")))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = spread(back, colours.filter("node = colour").select("node")).join(colours.hint("merge"), "node").select("node", F.col("colour").alias("component"))
        done.append(settled(found))
        gone = done[-1].select("node")
        left = settled(inside.join(gone.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti").select("src", "dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if done:
        nodes = nodes.join(_union(done).hint("merge"), "node", "left")
    else:
        nodes = nodes.withColumn("component", F.col("node"))
    nodes = settled(nodes.select("node", F.coalesce("component", "node").alias("component")))
    sizes = nodes.groupBy("component").agg(F.count("*").cast("bigint").alias("size"))
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("_l"))
    out = nodes.join(sizes.hint("merge"), "component").join(loops.hint("merge"), "node", "left")
    return out.select("node", "component", "size", ((F.col("size") > 1) | F.coalesce("_l", F.lit(False))).alias("cyclic"))


def divergence(edges: DataFrame) -> DataFrame:
    """node: those that can go on along silent edges for ever, as walks of any length start there. edges: src, dst (silent ones)."""
    return long_walk_ends(settled(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()))


def branch_points(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").cast("bigint").alias("out_degree")).filter("out_degree > 1")


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, longest: int | None = None) -> DataFrame:
    """path: arrays of nodes from a start to an end, none twice, of at most `longest` nodes if given."""
    now = starts.select(F.array("node").alias("path"))
    found, stop = None, ends.select(F.col("node").alias("_e")).distinct()
    for _ in itertools.count() if longest is None else range(longest):
        now = settled(now)
        done = now.join(stop, F.element_at("path", -1) == F.col("_e")).select("path")
        found = settled(done if found is None else found.unionByName(done))
        now = now.join(edges.select("src", "dst").distinct(), F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        if now.isEmpty():
            break
    return found


def mandatory(paths: DataFrame) -> DataFrame:
    """node: those on every path."""
    total = paths.agg(F.count("*").alias("_t"))
    counts = paths.select(F.explode(F.array_distinct("path")).alias("node")).groupBy("node").agg(F.count("*").alias("_c"))
    return counts.crossJoin(F.broadcast(total)).filter("_c = _t").select("node")


def per_graph(edges: DataFrame, key: str, run: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """Many graphs a task, one after the other, from rows sorted by graph; rows of a graph must fit in a task.

    `run` gets the columns of one graph and gives rows without the key. Batches are read and written whole, so a graph costs no frame of its own."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        def close() -> None:
            out.extend((held[key][0], *r) for r in run(held))

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            keys, lo = columns[key], 0
            while lo < len(keys):
                hi = bisect.bisect_right(keys, keys[lo], lo)
                part = {n: c[lo:hi] for n, c in columns.items()}
                if held and held[key][0] == keys[lo]:
                    held = {n: held[n] + part[n] for n in held}
                else:
                    if held:
                        close()
                    held = part
                lo = hi
            if len(out) > 10_000:
                yield made()
        if held:
            close()
        yield made()

    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]
    rows = edges.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    return rows.mapInArrow(results, schema)


def _pairs(g: dict[str, list]) -> list[tuple]:
    return [(a, b) for a, b in zip(g["src"], g["dst"], strict=True) if b is not None]


def dominators(edges: DataFrame, key: str = "graph", root: str = "root") -> DataFrame:
    """graph, node, dominators, immediate, frontier. edges: graph, src, dst (null for a node without edges), root."""

    def run(g: dict[str, list]) -> list[tuple]:
        pairs, r = _pairs(g), g[root][0]
        dom = graphs.dominators(r, pairs)
        up, front = graphs.immediate(dom), graphs.frontier(r, pairs, dom)
        return [(n, sorted(d), up.get(n), sorted(front[n])) for n, d in sorted(dom.items())]

    return per_graph(edges, key, run, f"{key} string, node string, dominators array<string>, immediate string, frontier array<string>")


def contracted(edges: DataFrame, bookkeeping: str = "^(pass|import|block)$", key: str = "graph") -> DataFrame:
    """graph, src, label, dst without bookkeeping nodes. edges: graph, src, src_type, label, dst, dst_type."""
    import re

    plain = re.compile(bookkeeping)

    def run(g: dict[str, list]) -> list[tuple]:
        kinds = dict(zip(g["src"], g["src_type"], strict=True)) | dict(zip(g["dst"], g["dst_type"], strict=True))
        edges_ = list(zip(g["src"], g["label"], g["dst"], strict=True))
        return graphs.contract({n: bool(plain.search(k or "")) for n, k in kinds.items()}, edges_)[1]

    return per_graph(edges, key, run, f"{key} string, src string, label string, dst string")


def ordering(dominated: DataFrame, pairs: DataFrame, key: str = "graph") -> DataFrame:
    """graph, a, b, ordered, path: whether every way to b passes a, and the dominators from a on. dominated: as `dominators`; pairs: graph, a, b."""
    d = dominated.select(key, F.col("node").alias("b"), "dominators")
    out = pairs.join(d, [key, "b"], "left")
    inside = F.coalesce(F.array_contains("dominators", F.col("a")), F.lit(False))
    return out.select(key, "a", "b", inside.alias("ordered"), "dominators")


def unrolled(edges: DataFrame, copies: int = 3, key: str = "graph") -> DataFrame:
    """graph, src, label, dst, trap: loop nodes as `copies` iterations, and a trap state behind the last one.

    edges: graph, src, src_loop (whether src is a loop node), label, dst, dst_loop. A loop's body is what its ways out reach; ways in from there are
    ways back. Entries go to the first copy; a way back goes to every later copy and to the trap. Loops are taken in order of their names."""

    def run(g: dict[str, list]) -> list[tuple]:
        now = [(a, x, b) for a, x, b in zip(g["src"], g["label"], g["dst"], strict=True) if b is not None]
        loops = {a for a, ok in zip(g["src"], g["src_loop"], strict=True) if ok} | {b for b, ok in zip(g["dst"], g["dst_loop"], strict=True) if ok}
        for loop in sorted(loops):
            plain = [(a, b) for a, _, b in now if a != loop]
            body = graphs.reach([b for a, _, b in now if a == loop and b != loop], [(a, b) for a, b in plain if b != loop])
            back, entry = [e for e in now if e[2] == loop and e[0] in body], [e for e in now if e[2] == loop and e[0] not in body and e[0] != loop]
            ahead, rest = [e for e in now if e[0] == loop and e[2] != loop], [e for e in now if loop not in (e[0], e[2])]
            if not back and not ahead:
                continue
            names = [f"{loop}_iter_{k}" for k in range(copies)]
            trap = f"{loop}_loop_exceeds_bound_error"
            now = rest + [(a, x, names[0]) for a, x, _ in entry] + [(n, x, b) for n in names for _, x, b in ahead]
            now += [(a, x, n) for n in names[1:] for a, x, _ in back] + [(a, x, trap) for a, x, _ in back]
        return sorted({(a, x, b, b.endswith("_loop_exceeds_bound_error")) for a, x, b in now}, key=repr)

    return per_graph(edges, key, run, f"{key} string, src string, label string, dst string, trap boolean")
