import hashlib
import math
import random
from collections import Counter

from sparktrail.llm import centroids


def brute(rows, size, k, rounds):
    """Plain Lloyd on all rows, in Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            pairs = [x.as_integer_ratio() for x in v]
            kept.append((i, [n * 1024 // d for n, d in pairs]))
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    now = [q for _, q in starts[:k]]

    def at(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(at(q)[1], []).append(q)
        now = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else c for n, c in enumerate(now)]
    placed = [(i, *at(q)) for i, q in kept]
    own, top = Counter(), (1 << 63) - 1
    for _, d, n in placed:
        own[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    whole = sum(own.values())
    return sorted(((i, n, min(d, top), min(own[n], top), min(whole, top), digest[n]) for i, d, n in placed), key=repr)


def ran(spark, rows, size, **extra):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS q", "2 AS n", "3 AS key", "4 AS cluster")
    return sorted((tuple(r) for r in centroids.cluster(df, size=size, **extra).collect()), key=repr)


def test_equal_to_plain_rounds_over_all_rows(spark):
    rng = random.Random(8)
    seeds = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(40)]
    rows = [(i, list(rng.choice(seeds))) for i in range(300)] + [(1000 + i, seeds[0]) for i in range(150)]  # a third are one vector
    rows += [(2000 + i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(5, seeds[1]), (5, seeds[1]), (None, seeds[2]), (None, None), (3000, [1.0] * 3), (3001, [None, 1.0, 1.0, 1.0]), (3002, [math.nan] * 4), (3003, [math.inf, 0.0, 0.0, 0.0]), (3004, [-0.0, 0.0, -1e-9, 1e-9])]
    assert ran(spark, rows, 4) == brute(rows, 4, 8, 10)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6, 12, 40]) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [1e12 + i, 0.5, -3.0]) for i in range(20)]
    assert ran(spark, rows, 3, k=3, rounds=4) == brute(rows, 3, 3, 4)


def test_middle_sizes_take_whole_numbers(spark):
    rng = random.Random(10)
    rows = [(i, [float(rng.randint(-(1 << 16), 1 << 16)) for _ in range(3)]) for i in range(80)]
    assert ran(spark, rows, 3, k=4, rounds=5) == brute(rows, 3, 4, 5)


def test_few_equal_and_no_rows(spark):
    same = [(i, [0.25, -0.25]) for i in range(12)]
    assert ran(spark, same, 2) == brute(same, 2, 8, 10) and {r[1] for r in ran(spark, same, 2)} == {0}
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert ran(spark, few, 2) == brute(few, 2, 8, 10)
    assert ran(spark, [], 2) == [] and ran(spark, [(1, None), (None, [1.0])], 2) == []


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(500, [None] * 4), (501, [1.0]), (502, None)]
    path = str(tmp_path / "embeddings.parquet")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(db.execute(centroids.sql(k=5, rounds=6, size=4)).fetchall(), key=repr)
    assert sorted((tuple(r) for r in centroids.cluster(df, k=5, rounds=6, size=4).collect()), key=repr) == want
