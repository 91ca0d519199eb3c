import random
import re

import numpy as np
import pytest
from sparktrail.llm import jaccard_join as jj
from sparktrail.llm import shingles as sh

SCHEMA = "doc_id long, text string, component_id string, n_chars long"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and rows[i][0] is not None and rows[j][0] is not None and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)) if r[0] is not None else None)) for i, r in enumerate(rows))


def data(seed, many=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(many):
        base = [word() for _ in range(rng.choice([2, 5, 12, 40, 120, 400]))]
        if rng.random() < 0.3:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).replace("a", rng.choice("aA")))
    rows += [None, "", " \n", "one", "One", "two words", "no break one", "long " * 30_000]
    rng.shuffle(rows)
    out = [(3 * i + 1, t, "clash", len(t or "")) for i, t in enumerate(rows)]
    return [*out, out[4], (None, rows[7], None, None)]


@pytest.mark.parametrize("size,percent,local,cell", [(3, 90, 256, 1000), (5, 80, 256, 1000), (3, 90, 3, 1000), (5, 80, 4, 3)])
def test_brute_force(spark, monkeypatch, size, percent, local, cell):
    monkeypatch.setattr(jj, "LOCAL", local)
    monkeypatch.setattr(jj, "CELL", cell)
    rows = data(size + percent)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join(df, size, percent).collect())
    assert got == brute(rows, size, percent)


def test_one_of_each(spark):
    rows = data(11, 25)
    df = spark.createDataFrame(rows, SCHEMA)
    out = jj.one_of_each(df)
    assert out.columns == df.columns
    want = sorted({i for i, _, c in brute(rows, 5, 80) if i == c} | {"None"})
    assert sorted(str(r.doc_id) for r in out.collect()) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jj.join(df).count() == 0 and jj.one_of_each(df).count() == 0


@pytest.mark.parametrize("percent", [50, 76, 80, 90])
def test_linked_sets_share_neighbours(percent):
    rng = np.random.default_rng(percent)
    word = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for k in range(4000):
        a = np.unique(word(int(rng.integers(1, 60))))
        cut, new = rng.integers(0, len(a) // 2 + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[cut:], word(int(new) if k % 3 else 0)]))
        heavy = np.sort(rng.permutation(np.union1d(a, b))[: k % 5])
        n = len(np.intersect1d(a, b))
        if len(a) != len(b) and 100 * n >= percent * (len(a) + len(b) - n):
            one, two = (sh.neighbours(x, percent, heavy, np.arange(len(heavy))) for x in (a, b))
            assert np.intersect1d(one, two).size
    assert jj.keys_of([jj.packed(one)]).tolist() == one.tolist()


def test_texts_that_share_single_shingles_stay_apart(spark):
    rng = random.Random(5)
    phrases = [" ".join(f"p{k}w{i}" for i in range(5)) for k in range(60)]
    rows = [(d, " ".join(w for k in rng.sample(range(60), 6) for w in (phrases[k], *(f"d{d}x{k}y{i}" for i in range(60)))), "", 0) for d in range(80)]
    counts = {}
    found = jj.join(spark.createDataFrame(rows, SCHEMA), 5, 80, counts).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 386 for r in found) and len(found) == 80
    assert counts["near"] < 8  # 92 by single members of their prefixes
