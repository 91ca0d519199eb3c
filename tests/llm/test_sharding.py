import random
import zlib
from collections import defaultdict

from sparktrail.llm import sharding


def starts(sizes, capacity):
    """Where shards 1, 2, ... start if each takes as much as it holds."""
    out, held = [], 0
    for i, n in enumerate(sizes):
        if held + n > capacity:
            out.append(i)
            held = 0
        held += n
    return out


def exact(sizes, shards):
    return next(c for c in range(max([*sizes, -(-sum(sizes) // shards)]), sum(sizes) + 1) if len(starts(sizes, c)) < shards)


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    for n, top in ((3000, 50), (900, 5000), (10, 9)):
        keys = sorted({rng.getrandbits(64) - (1 << 63) for _ in range(n)})
        sizes = [rng.randint(1, top) for _ in keys]
        if n == 900:
            sizes[100] = sum(sizes) // 3
        groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, n long")
        points, capacity = sharding.cut_points(groups, 24)
        assert capacity == exact(sizes, 24)
        assert [keys[i] for i in starts(sizes, capacity)] == points


def test_rows(spark):
    rows = [(i, f"text {i % 700} é" * (i % 13), "x") for i in range(2000)] + [(1, "text 1 é", "x"), (None, None, None), (7, None, "y")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, size string")).collect()
    assert len(got) == len(rows)
    slots, homes, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in homes.values())
    assert len(sizes) == 24


def test_a_very_long_text_sets_the_capacity(spark):
    rows = [(i, f"text {i} " * 9) for i in range(300)] + [(9000, "é long " * 300_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    long = next(r for r in got if r.doc_id == 9000)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 301 and long.size == 8 * 300_000 + 8 == max(sizes.values()) and long.text_crc32 == zlib.crc32(rows[-1][1].encode())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
