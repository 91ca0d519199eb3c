"""Centroid clustering by weighted de-duplication: Lloyd's rounds run on distinct quantised vectors with multiplicities.

Components become integers, floor(scale * x). Equal integer vectors are grouped and counted once; each round assigns the
distinct vectors and adds them up with their multiplicities, in whole numbers, so that neither the order of rows nor the
number of partitions changes a result. The last assignment is joined back to the rows by the SHA-256 of the vector. The
driver holds the centroids and one sum a centroid and component. Vectors that hold more than a thousandth of all rows
(fewer than a thousand, then) are joined by broadcast, so no key of the shuffled join is hot.

Distances are matrix products of doubles while every number in them stays below 2^53, else 64-bit integers, else Python's
integers; all three are exact.

Defined cases: a null vector, one of another length, and one with a null or non-finite component are left out; equal rows
and repeated ids are rows of their own; a null id is clustered but never starts a centroid; fewer rows than centroids start
fewer centroids; equal starting vectors leave the later centroid empty, where it stays; a distance or sum beyond a long is
given as the largest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Sums travel as digits of this base, so that they never overflow.
LIMB = 10**18
TOP = (1 << 63) - 1
#: A vector with more than this share of all rows is joined by broadcast.
HOT = 1000


def narrow_bound(size: int) -> int:
    """Components below it have squared distances that fit 63 bits."""
    return 1 << ((62 - size.bit_length()) // 2 - 1)


def packed(vectors: DataFrame, size: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, q: the integers of each vector that is kept: `n` and 32-bit integers, or `w` and decimal text where one is large."""
    bound = narrow_bound(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            good = np.isfinite(x).all(axis=1)
            x, ids = x[good], batch.column(0).filter(pa.array(good))
            with np.errstate(over="ignore"):
                whole = np.floor(x * scale)
            large = (np.abs(whole) >= bound).any(axis=1)
            out = np.zeros((len(x), 1 + 4 * size), np.uint8)
            out[:, 0] = ord("n")
            out[~large, 1:] = whole[~large].astype("<i4").view(np.uint8)
            if not large.any():
                q = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1 + 4 * size), len(x), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
            else:  # an exact product: doubles are ratios of whole numbers
                text = lambda row: ",".join(str(n * scale // d) for n, d in (v.as_integer_ratio() for v in row))
                q = pa.array([b"w" + text(x[i].tolist()).encode() if large[i] else out[i].tobytes() for i in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, q], ["vec_id", "q"])

    rows = vectors.filter(F.size(vector) == size).select(F.col(key).alias("vec_id"), F.col(vector).alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, q binary")


def unpacked(q: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and integers of the narrow vectors, then of the wide ones (as Python's integers)."""
    rows = q.to_pylist()
    wide = np.array([r[:1] == b"w" for r in rows], bool)
    flat = b"".join(r[1:] for r, w in zip(rows, wide.tolist(), strict=True) if not w)
    narrow = np.frombuffer(flat, "<i4").reshape(-1, size)
    large = np.array([[int(v) for v in rows[i][1:].split(b",")] for i in np.flatnonzero(wide)], object).reshape(-1, size)
    return np.flatnonzero(~wide), narrow, np.flatnonzero(wide), large


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the least number among equals, and the squared distance."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = x.shape[1]
    top = max(int(abs(x).max()), *(abs(v) for c in centroids for v in c))
    if x.dtype != object and 4 * size * top * top < 1 << 53:
        c, y = np.array(centroids, np.float64), x.astype(np.float64)
        far = (y * y).sum(axis=1)[:, None] - 2 * (y @ c.T) + (c * c).sum(axis=1)
    else:
        kind = np.int64 if x.dtype != object and top <= narrow_bound(size) else object
        y = x.astype(kind)
        far = np.stack([((y - np.array(c, kind)) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = np.array(far.argmin(axis=1), np.int64)
    best = far[np.arange(len(at)), at]
    return at, best.astype(np.int64) if best.dtype != object else np.array([min(int(d), TOP) for d in best], np.int64)


def assigned(batch: pa.RecordBatch, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in the batch, integers, centroids and distances: of narrow rows, then of wide ones."""
    a, x, b, y = unpacked(batch.column("q"), len(centroids[0]))
    for places, rows in ((a, x), (b, y)):
        if len(places):
            yield places, rows, *nearest(rows, centroids)


def weighted_sums(distinct: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Rows of each centroid and their componentwise sums, multiplicities counted. distinct: q, n."""
    k, size = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), object), [0] * k
        for batch in batches:
            weights = batch.column("n").to_numpy(zero_copy_only=False)
            for places, x, at, _ in assigned(batch, centroids):
                w = weights[places]
                room = int(abs(x).max()) * int(w.sum())
                kind = np.float64 if room < 1 << 53 else np.int64 if room < 1 << 62 else object
                for c in np.unique(at).tolist():
                    mine = at == c
                    total = w[mine].astype(kind) @ x[mine].astype(kind)
                    sums[c] += np.array([int(v) for v in total], object)
                    counts[c] += int(w[mine].sum())
        out: list[tuple[int, int, int, int]] = []
        for c in range(k):
            if counts[c]:
                for j, v in enumerate([counts[c], *sums[c]]):
                    sign, rest, power = (-1 if v < 0 else 1), abs(v), 0
                    while rest or not power:
                        out.append((c, j, power, sign * (rest % LIMB)))
                        rest, power = rest // LIMB, power + 1
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["c", "j", "power", "v"])

    parts = distinct.select("q", "n").mapInArrow(run, "c int, j int, power int, v long")
    counts, sums = [0] * k, [[0] * size for _ in range(k)]
    for r in parts.groupBy("c", "j", "power").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # centroids x components
        v = int(r.v) * LIMB**r.power
        if r.j == 0:
            counts[r.c] += v
        else:
            sums[r.c][r.j - 1] += v
    return counts, sums


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """Centroids after the rounds; an empty one stays where it is. Ends early when none has moved, which later rounds can't change."""
    for _ in range(rounds):
        counts, sums = weighted_sums(distinct, centroids)
        moved = [[s // n for s in sums[c]] if (n := counts[c]) else centroids[c] for c in range(len(centroids))]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def key_of() -> Column:
    """The SHA-256 of a vector, which stands for it in the join back."""
    return F.unhex(F.sha2("q", 256))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row a row that is kept."""
    spark = vectors.sparkSession
    work = Workspace(spark, "centroids")
    rows = work.keep(packed(vectors, size, scale, key, vector).withColumn("key", key_of()), "rows")
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.filter(F.col("vec_id").isNotNull()).select(rank.alias("rank"), "q").orderBy("rank", "q").limit(k).collect()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    starts = []
    for r in first:
        _, x, _, y = unpacked(pa.array([bytes(r.q)], pa.binary()), size)
        starts.append([int(v) for v in (*x, *y)[0]])
    distinct = work.keep(rows.groupBy("q").agg(F.count("*").alias("n")).withColumn("key", key_of()), "distinct")
    centroids = lloyd(distinct, starts, rounds)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for places, _, at, far in assigned(batch, centroids):
                cluster[places], distance[places] = at, far
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(cluster), pa.array(distance)], ["key", "n", "cluster", "distance"])

    placed = work.keep(distinct.select("q", "n", "key").mapInArrow(last, "key binary, n long, cluster int, distance long"), "placed")
    total = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    found = {r.cluster: (int(r.n), int(r.d)) for r in placed.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("d")).collect()}  # a row a centroid
    n, inertia = sum(v[0] for v in found.values()), min(sum(v[1] for v in found.values()), TOP)
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in found}
    facts = F.create_map(*[x for c, (_, d) in sorted(found.items()) for x in (F.lit(c), F.struct(F.lit(min(d, TOP)).cast("long").alias("d"), F.lit(digest[c]).alias("h")))])
    hot = F.col("n") * HOT > F.lit(n)
    common = F.broadcast(placed.filter(hot).select("key", "cluster", "distance"))
    ids, rare = rows.select("vec_id", "key"), placed.filter(~hot).select("key", "cluster", "distance")
    out = ids.join(common, "key").unionByName(ids.join(common.select("key"), "key", "left_anti").join(rare.hint("merge"), "key"))
    return out.select("vec_id", "cluster", "distance", facts[F.col("cluster")]["d"].alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), facts[F.col("cluster")]["h"].alias("centroid_sha256"))


def sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """The same in DuckDB's SQL, a pair of tables a round."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        f" WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('{salt}:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {far}, c := c.c)) AS m FROM v, c{i} c GROUP BY r)")
        if i < rounds:
            parts.append(
                f"s{i} AS (SELECT m.c AS c, j, sum(v.q[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {size} + 1) t(j) GROUP BY ALL),"
                f"n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY c),"
                f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN n{i} n USING (c))"
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(m.c AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m.c"
    )
