import re
from collections import defaultdict

from sparktrail.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, position string"


def wanted(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def data():
    rows = [(i, " ".join(["w"] * (i * 7 % 90 + 1)), "big", 1, "x") for i in range(300)]
    rows += [(1000 + i, "a b\tc\n" * (i + 1), f"s{i % 4}", 1, "x") for i in range(20)]
    return [*rows, rows[5], (5000, None, None, None, None), (5001, "q " * 40, None, None, None), (5002, "", "void", 0, "x"), (None, "id less", "s1", 1, "x"), (5003, "été " * 9000, "Ω", 1, "x")]


def test_targets_and_takes(spark):
    rows = data()
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = wanted(sizes)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1.5 for s in sizes)
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_curriculum(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    out = mixing.curriculum(df)
    assert out.columns == df.columns
    plan = {(r.doc_id, r.source): r for r in mixing.mix(df).collect()}
    counts, words = defaultdict(int), defaultdict(int)
    for r in out.collect():
        counts[r.doc_id, r.source] += 1
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for key, r in plan.items():
        assert counts[key] <= 6 and (r.size == 0 or r.target < r.source_size or counts[key] >= r.target // max(1, r.source_size))
        assert abs(words[key[1]] - r.target) <= max(x.size for x in plan.values() if x.source == key[1]) + 40


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.curriculum(df).count() == 0
