import hashlib
import random

import numpy as np
from sparktrail.llm import suffix_dedup as sd


def brute(rows):
    """rows: (id, text), ids distinct."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def data(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(20, 90)) for _ in range(6)]
    texts = []
    for _ in range(70):
        t = prose(rng.choice([3, 20, 80, 250]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(passages) + t[k:]
        texts += [t] * rng.choice([1, 1, 1, 3])
        if rng.random() < 0.4:
            for _ in range(rng.randint(1, 9)):
                k = rng.randint(0, len(t))
                texts.append(t[:k] + word() + t[k + rng.randint(0, 5) :])
    texts += ["x" * 400, "x" * 150, "ab" * 300, "abc" * 90, "y" * 99, "y" * 99, "z" * 100, "z" * 100, "", None, "q" * 5000 + prose(2000)]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def test_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = data(seed) + [(None, "no id " * 40)]
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, n_bytes string, tie int").repartition(6)
        want = brute(rows)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(df).collect()}
        assert got == want


def test_frequent_anchors_by_their_surroundings(spark):
    rng = random.Random(8)
    line = "-" * 70 + "=" * 30 + "+" * 90
    rows = data(3) + [(20_000 + i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 130))) + line + "".join(rng.choice("abc ") for _ in range(130))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (0, 3, 40):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(df, hot=hot).collect()}
        assert got == brute(rows), hot


def windows(raws):
    """The offset of the anchor in each window, by text and window."""
    return {(k, w): (p - w, h) for k, p, h, a, z in zip(*(x.tolist() for x in sd.anchors(raws)), strict=True) for w in range(a, z + 1)}


def test_equal_windows_choose_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(4)
    passage = b"ab" * 150
    text = bytearray(rng.choice(b"abcdefgh") for _ in range(9000))
    for at in (100, 2048 - 150, 4096 - 299, 8000):
        text[at : at + 300] = passage
    raws = [b"", bytes(text), b"x" * 99, b"y" * 100, bytes(text[50:600])]
    whole = windows(raws)
    monkeypatch.setattr(sd, "SLICE", 256)
    assert windows(raws) == whole and len(whole) == sum(max(0, len(r) - 99) for r in raws)
    chosen = {}
    for (k, w), found in whole.items():
        assert chosen.setdefault(raws[k][w : w + 100], found) == found


def test_places_beyond_24_bits():
    """A passage far into a long text chooses the same anchors as near its start."""
    rng = np.random.default_rng(5)
    long = rng.integers(97, 123, (1 << 24) + 5000).astype(np.uint8)
    passage = np.frombuffer(b"ab" * 300, dtype=np.uint8)
    for at in (100_000, (1 << 24) - 300):
        long[at : at + 600] = passage
    _, place, g, first, last = sd.anchors([long.tobytes()])
    near, far = ({(int(p - a), int(h)) for p, h, a, z in zip(place, g, first, last) if at <= a and z + 100 <= at + 600} for at in (100_000, (1 << 24) - 300))
    offsets = [{int(p - w) for p, a, z in zip(place, first, last) if z >= at and a <= at + 500 for w in range(max(a, at), min(z, at + 500) + 1)} for at in (100_000, (1 << 24) - 300)]
    assert offsets[0] == offsets[1] and near and far


def test_sort_equal():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for a in range(200, 2800, 150):
        data[a : a + 130] = data[:130]
    starts = np.arange(0, 2900 - 8)
    first = sd.sort_equal(data, starts, np.zeros(len(starts), dtype=np.int64))
    seen = {}
    for s in starts.tolist():
        assert first[s] == seen.setdefault(data[s : s + 100].tobytes(), s)


def test_repeated_ids_and_empty(spark):
    long = "some words " * 30
    rows = [(5, long), (5, long), (5, long + "and more"), (6, long), (None, None), (None, long)]
    got = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and all(r.n_removed == r.n_bytes for r in got if r.doc_id == 6)
    assert len({(r.n_removed, r.kept_sha256) for r in got if r.doc_id == 5 and r.n_bytes == len(long)}) == 1
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
