"""Matching names and texts: equal, near by spelling, near by vector, and greedy one to one."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import plain
from .graph import settled

#: Pivots of all lengths together, and the vectors that they are fitted on: bounds of what the driver holds.
PIVOTS, FITTED = 64, 2048
#: Bytes of a block at most, and blocks of queries that meet one copy of an index block.
BLOCK_BYTES, MEET = 4 << 20, 64
#: Angles are told apart from this difference on; bounds give way by it.
MARGIN = 1e-6
LAST = np.iinfo(np.int64).max
FLAT = "dim = -1 OR zero"
_PLACED = "id bigint, more bigint, dim int, region int, angles array<double>, vector binary"
_BLOCK = "b bigint, dim int, region int, n int, low array<double>, high array<double>, near double, far double, ids binary, mores binary, block binary"


def spelling(actions: DataFrame, tasks: DataFrame, most: int = 2) -> DataFrame:
    """action, task, tier: 1 for equal plain names, 2 for an edit distance of `most` at most; the earliest task (pos) of the better tier.

    Near names share one of most + 1 pieces of the task's name at a shift of `most` at most, so candidates come from an
    equi join on pieces and lengths differ by `most` at most; no pair of all is formed."""
    a = actions.select("action").distinct().withColumn("x", plain(F.col("action")))
    t = tasks.select("task", "pos").withColumn("y", plain(F.col("task")))
    equal = a.join(t, F.col("x") == F.col("y")).select("action", "task", "pos", F.lit(1).alias("tier"))
    n, parts = F.length("y"), most + 1
    start = lambda k: F.floor(n * k / parts).cast("int")
    pieces = t.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), start(F.lit(k)).alias("s"), F.substring(F.col("y"), start(F.lit(k)) + 1, start(F.lit(k + 1)) - start(F.lit(k))).alias("piece")) for k in range(parts)])))
    pieces = pieces.select("task", "pos", "y", F.length("y").alias("n"), F.col("_p.k").alias("k"), F.col("_p.s").alias("s"), F.col("_p.piece").alias("piece"))
    grams = a.withColumn("n", F.explode(F.sequence(F.greatest(F.length("x") - most, F.lit(0)), F.length("x") + most)))
    grams = grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    lo = F.floor(F.col("n") * F.col("k") / parts).cast("int")
    size = F.floor(F.col("n") * (F.col("k") + 1) / parts).cast("int") - lo
    grams = grams.withColumn("s", lo).withColumn("_z", size).withColumn("_d", F.explode(F.sequence(F.lit(-most), F.lit(most)))).filter("s + _d >= 0")
    grams = grams.withColumn("piece", F.substring(F.col("x"), F.col("s") + F.col("_d") + 1, F.col("_z"))).select("action", "x", "n", "k", "piece").distinct()
    near = grams.join(pieces, ["n", "k", "piece"]).select("action", "x", "task", "pos", "y").distinct()
    near = near.filter((F.col("x") != F.col("y")) & (F.levenshtein("x", "y", most) >= 0)).select("action", "task", "pos", F.lit(2).alias("tier"))
    first = Window.partitionBy("action").orderBy("tier", "pos")
    return equal.unionByName(near).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("action", "task", "tier")


def _prepared(df: DataFrame) -> DataFrame:
    """id, vector, dim, zero; a vector that is null or has a null, NaN or infinity in it has dim -1."""
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    dim = F.when(F.col("vector").isNull() | odd, F.lit(-1)).otherwise(F.size("vector"))
    return rows.withColumn("dim", dim).withColumn("zero", F.coalesce(~F.exists("vector", lambda x: x != 0), F.lit(True)))


def _distinct(rows: DataFrame) -> DataFrame:
    """id, more, vector, dim: vectors other than flat ones once each, with their least id and the next one, which is the same if there is none."""
    rows = rows.filter(f"NOT ({FLAT})").select("id", "vector", "dim")
    one = settled(rows.groupBy("vector", "dim").agg(F.min("id").alias("one"), F.max("id").alias("last")))
    more = rows.join(one.filter("last > one").select("vector", "one"), "vector").filter("id > one").groupBy("vector").agg(F.min("id").alias("more"))
    return one.join(more, "vector", "left").select(F.col("one").alias("id"), F.coalesce("more", "one").alias("more"), "vector", "dim")


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _pivots(index: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors a length: centres of a bounded sample (least hashes of ids), by a few rounds of spherical k-means. They steer work only."""
    sample = index.filter(f"NOT ({FLAT})").orderBy(F.xxhash64("id"), "id").limit(FITTED).select("dim", "vector").collect()
    out = {}
    for dim in sorted({r.dim for r in sample}):
        x = _units(np.array([r.vector for r in sample if r.dim == dim]))
        x = np.unique(x, axis=0)
        most = max(1, min(PIVOTS * len(x) // len(sample), int(len(x) ** 0.5)))
        at = [0]
        while len(at) < most:  # the furthest from all so far
            at.append(int((x @ x[at].T).max(axis=1).argmin()))
        centres = x[at]
        for _ in range(4):
            home = (x @ centres.T).argmax(axis=1)
            sums = np.array([x[home == k].sum(axis=0) for k in range(most)])
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
        out[dim] = centres
    return out


def _blocks(df: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Vectors in blocks of one length and Voronoi region, by angle to the region's pivot, with least and greatest angle to every pivot."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims, ids = batch.column("vector").to_pylist(), batch.column("dim").to_numpy(), batch.column("id")
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                wide = np.array([vectors[i] for i in rows])
                narrow = wide.astype(np.float32)
                same = (narrow == wide).all(axis=1)  # half the bytes where nothing is lost
                packed = [narrow[i].tobytes() if s else wide[i].tobytes() for i, s in enumerate(same)]
                far = _angles(_units(wide), pivots[dim]) if dim in pivots else np.zeros((len(rows), 1))
                yield pa.RecordBatch.from_pydict({
                    "id": ids.take(pa.array(rows)), "more": batch.column("more").take(pa.array(rows)), "dim": pa.array(np.full(len(rows), dim), pa.int32()), "region": pa.array(far.argmin(axis=1), pa.int32()),
                    "angles": pa.array(far.tolist(), pa.list_(pa.float64())), "vector": pa.array(packed, pa.binary())})

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)

        def block(rows: list[tuple]) -> pa.RecordBatch:
            dim, region = rows[0][2:4]
            far = np.array([r[4] for r in rows])
            own = far[:, region]
            if len({len(r[5]) for r in rows}) == 1:
                data = b"".join(r[5] for r in rows)
            else:
                data = b"".join(r[5] if len(r[5]) == 8 * dim else np.frombuffer(r[5], np.float32).astype(np.float64).tobytes() for r in rows)
            row = [next(number), dim, region, len(rows), far.min(axis=0).tolist(), far.max(axis=0).tolist(), own.min(), own.max(), *(np.array([r[k] for r in rows], np.int64).tobytes() for k in (0, 1)), data]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        held: list[tuple] = []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (held[0][2:4] != r[2:4] or len(held) >= max(1, min(size, BLOCK_BYTES // (8 * r[2])))):
                    yield block(held)
                    held = []
                held.append(r)
        if held:
            yield block(held)

    schema = to_arrow_schema(T._parse_datatype_string(_BLOCK))
    placed = settled(df.select("id", "more", "vector", "dim").mapInArrow(place, _PLACED))
    keys = [F.col("dim"), F.col("region"), F.element_at("angles", F.col("region") + 1), F.col("id")]
    return settled(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, _BLOCK))


def _scored(pairs: DataFrame, q: DataFrame, v: DataFrame, parts: int) -> DataFrame:
    """qb, id, match, similarity: each query's best of a block, for pairs (qb, vb) of blocks.

    Blocks meet in sorted partitions: one index block is held at a time while its blocks of queries pass by, and it is
    sent once for some MEET of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                units = _units(np.frombuffer(r["block"], np.float32 if len(r["block"]) == 4 * len(ids) * r["dim"] else np.float64).reshape(len(ids), r["dim"]).astype(np.float64))
                if r["qb"] is None:
                    others, mores, held = ids, np.frombuffer(r["mores"], np.int64), units
                    continue
                scores = units @ held.T
                order = np.argsort(others, kind="stable")
                at = np.searchsorted(others, ids, sorter=order)
                there = np.flatnonzero(at < len(others))
                own = there[others[order[at[there]]] == ids[there]]
                for i in own:
                    scores[i, (others == ids[i]) & (mores == ids[i])] = -np.inf
                most = scores.max(axis=1)
                top = scores >= most[:, None] - 1e-12
                best = np.where(top, others, LAST).min(axis=1)  # of equal ones the least id
                for i in own:
                    best[i] = np.where(top[i], np.where(others == ids[i], mores, others), LAST).min()
                ok = most != -np.inf
                yield pa.RecordBatch.from_pydict({"qb": pa.array(np.full(int(ok.sum()), r["qb"]), pa.int64()), "id": pa.array(ids[ok]), "match": pa.array(best[ok]), "similarity": pa.array(np.round(most[ok], 12))})

    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("qb"), F.lit(parts)))
    asked = pairs.join(q.select(F.col("b").alias("qb"), "dim", "ids", "mores", "block"), "qb").select("vb", "part", "qb", "dim", "ids", "mores", "block")
    given = pairs.select("vb", "part").distinct().join(v.select(F.col("b").alias("vb"), "dim", "ids", "mores", "block"), "vb")
    rows = given.select("vb", "part", F.lit(None).cast("bigint").alias("qb"), "dim", "ids", "mores", "block").unionByName(asked)
    together = rows.repartition("vb", "part").sortWithinPartitions("vb", "part", F.col("qb").asc_nulls_first())
    return together.mapInArrow(run, "qb bigint, id bigint, match bigint, similarity double")


def _best(scores: DataFrame) -> DataFrame:
    best = scores.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("match")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("match"), F.col("b.similarity").alias("similarity"))


def _level(queries: DataFrame, index: DataFrame) -> DataFrame:
    """id, match, similarity 0: for each query the least other id of the index at a right angle by definition, if any."""

    def two(df: DataFrame) -> DataFrame:
        one = df.groupBy("dim").agg(F.min("id").alias("one"))
        more = df.join(F.broadcast(one) if one.limit(10_001).count() <= 10_000 else one, "dim").filter("id > one").groupBy("dim").agg(F.min("id").alias("more"))
        return one.join(more, "dim", "left")

    ids = index.select("dim", "id", "zero")
    all_, flat = two(ids), two(ids.filter(FLAT))
    null = flat.filter("dim = -1").select(F.col("one").alias("n1"), F.col("more").alias("n2"))
    least = two(ids.withColumn("dim", F.lit(0))).select(F.col("one").alias("a1"), F.col("more").alias("a2"))
    by = all_.select("dim", F.col("one").alias("l1"), F.col("more").alias("l2")).join(flat.select("dim", F.col("one").alias("f1"), F.col("more").alias("f2")), "dim", "left")
    q = queries.select("id", "dim", "zero").join(by, "dim", "left")
    for one_row in (null, least):  # a row at most
        q = q.join(F.broadcast(one_row), F.lit(True), "left")
    own = F.when(F.col("dim") == -1, F.array("a1", "a2")).when(F.col("zero"), F.array("l1", "l2", "n1", "n2")).otherwise(F.array("f1", "f2", "n1", "n2"))
    rest = F.array_min(F.filter(own, lambda x: x != F.col("id")))
    return q.select("id", rest.alias("match"), F.lit(0.0).alias("similarity")).filter("match IS NOT NULL")


def search(queries: DataFrame, index: DataFrame, size: int = 512) -> tuple[DataFrame, dict[str, int]]:
    """id, match, similarity of each query's nearest vector (see `by_vector`), and how many pairs of blocks there are and were scored."""
    queries, index = settled(_prepared(queries)), settled(_prepared(index))
    pivots = _pivots(index)
    asked = queries.filter(f"NOT ({FLAT})").withColumn("more", F.col("id"))
    q, v = _blocks(asked, pivots, size), _blocks(_distinct(index), pivots, size)
    blocks = q.count()
    parts = max(1, -(-blocks // MEET))
    names = ("b", "dim", "region", "low", "high", "near", "far")
    qm = q.select(*[F.col(c).alias("qb" if c == "b" else c if c == "dim" else f"q_{c}") for c in names], F.col("n").alias("q_n"))
    vm = v.select(*[F.col(c).alias("vb" if c == "b" else c if c == "dim" else f"v_{c}") for c in names])
    close = (F.col("q_region") == F.col("v_region")) & (F.col("q_near") <= F.col("v_far")) & (F.col("v_near") <= F.col("q_far"))
    mine = vm.select("dim", "vb", F.col("v_region").alias("q_region"), "v_region", "v_near", "v_far")
    first = settled(qm.join(mine, ["dim", "q_region"]).filter(close).select("qb", "vb"))
    known = settled(_scored(first, q, v, parts))
    # the furthest that a query of a block still has to look
    reach = known.groupBy("qb", "id").agg(F.max("similarity").alias("s")).groupBy("qb").agg(F.count("*").alias("k"), F.acos(F.greatest(F.min("s"), F.lit(-1.0))).alias("reach"))
    qm = qm.join(reach, "qb", "left").withColumn("reach", F.when(F.col("k") == F.col("q_n"), F.coalesce(F.nanvl("reach", F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(4.0)) + MARGIN)
    apart = F.exists(F.arrays_zip("q_low", "q_high", "v_low", "v_high"), lambda x: (x.q_low - x.v_high > F.col("reach")) | (x.v_low - x.q_high > F.col("reach")))
    # regions first: they are few, so blocks of far regions never meet
    spans = vm.select("dim", "v_region", F.posexplode("v_low").alias("p", "low"), "v_high").withColumn("high", F.element_at("v_high", F.col("p") + 1))
    spans = spans.groupBy("dim", "v_region", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = spans.groupBy("dim", "v_region").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("s"))
    regions = settled(whole.select("dim", "v_region", F.col("s.low").alias("v_low"), F.col("s.high").alias("v_high")))
    met = qm.join(regions, "dim").filter(~apart).drop("v_low", "v_high")
    second = settled(met.join(vm, ["dim", "v_region"]).filter(~apart & ~close).select("qb", "vb"))
    found = known.unionByName(_scored(second, q, v, parts)).drop("qb")
    told = {"blocks": blocks, "index_blocks": v.count(), "pairs": blocks * v.count(), "first": first.count(), "second": second.count()}
    return _best(found.unionByName(_level(queries, index))), told


def by_vector(queries: DataFrame, index: DataFrame, least: float = 0.85, size: int = 512) -> DataFrame:
    """id, match, similarity: the nearest vector of the whole index by cosine, to 12 places; of equal ones the least id. Ids are whole numbers.

    Exact, with triangle bounds on angles over the distinct vectors of the index: blocks of one Voronoi region whose angles overlap are scored first; after that only
    those whose bound by some pivot isn't beyond the worst of a block's best angles. No pair of all blocks is formed, unless the
    bounds can't tell them apart. A vector of zeros or with nulls, NaN or infinities has similarity 0; vectors of different
    lengths aren't compared, but one with nulls has no length and meets all."""
    return search(queries, index, size)[0].filter(F.col("similarity") >= least)


def greedy(left: DataFrame, right: DataFrame, kind: str, text: str) -> DataFrame:
    """left_id, right_id, how: equal (kind, text) in order one to one, then the rest of a kind in order. Both sides: id, kind, text."""

    def placed(df: DataFrame, name: str, *by: str) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).withColumnRenamed("id", name)

    a, b = placed(left, "left_id", kind, text), placed(right, "right_id", kind, text)
    exact = a.join(b, [kind, text, "_rn"]).select("left_id", "right_id", F.lit("text").alias("how"))
    rest = [df.join(exact.select(F.col(c).alias("id")), "id", "left_anti") for df, c in ((left, "left_id"), (right, "right_id"))]
    a, b = placed(rest[0], "left_id", kind).drop(text), placed(rest[1], "right_id", kind).drop(text)
    return exact.unionByName(a.join(b, [kind, "_rn"]).select("left_id", "right_id", F.lit("position").alias("how")))


def contains_either(a: Column, b: Column) -> Column:
    x, y = plain(a), plain(b)
    return F.contains(x, y) | F.contains(y, x)
