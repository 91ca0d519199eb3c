import hashlib
import random

from sparktrail.llm import fingerprints as fp


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in "xy")
        assert fp.distance(a, b) == plain_distance(a, b)
    a, b = ("".join(rng.choice(fp.CODE) for _ in range(64)) for _ in "xy")
    assert fp.distance(a, b) == plain_distance(a, b)


def test_fingerprint_is_local_and_stable():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    text = " ".join(rng.choice(words) for _ in range(700))
    whole = fp.fingerprint(text.encode())
    assert whole == fp.fingerprint(text.encode()) and len(whole.split(":")[1]) <= fp.LENGTH
    changed = text[:2000] + "changed" + text[2010:]
    other = " ".join(rng.choice(words) for _ in range(700))
    assert fp.likeness(whole, fp.fingerprint(changed.encode())) > 0.85
    assert fp.likeness(whole, fp.fingerprint(other.encode())) < 0.35
    assert fp.likeness(whole, fp.fingerprint(text[: len(text) * 3 // 4].encode())) > 0.5
    assert fp.fingerprint(b"") == "3::" and fp.likeness("3::", "3::") == 1.0 and fp.likeness("3::", whole) == 0.0


def mixed64(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % 2**64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 % 2**64
    return x ^ x >> 33


def brute(raw):
    """The fingerprint from its definition, byte by byte."""
    if not raw:
        return "3::"

    def roll(i):
        t = sum((raw[i - k] + 1) * pow(0x01000193, k + 1, 2**32) for k in range(min(7, i + 1))) % 2**32
        t ^= t >> 15
        t = t * 0x2C1B3C6D % 2**32
        return t ^ t >> 12

    rolls = [roll(i) for i in range(len(raw))]

    def chunks(size):
        out, now = [], b""
        for i, r in enumerate(rolls):
            now += raw[i : i + 1]
            if r % size == size - 1 and len(out) < 63:
                out.append(now)
                now = b""
        return out + [now] * bool(now)

    def sign(size):
        return "".join(fp.CODE[mixed64((sum((b + 1) * pow(0x100000001B3, j, 2**64) for j, b in enumerate(c)) + len(c)) % 2**64) % 64] for c in chunks(size))

    size = 3
    while size * 64 < len(raw):
        size *= 2
    while size > 3 and sum(r % size == size - 1 for r in rolls) + 1 < 32:
        size //= 2
    return f"{size}:{sign(size)}:{sign(2 * size)}"


def test_fingerprint_by_its_definition_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(12)
    raws = [b"", b"a", b"abcdefg", b"x" * 3000, b"ab" * 700]
    raws += [bytes(rng.choice(b"abcdefgh \n\xc3\xa9") for _ in range(rng.randint(1, 4000))) for _ in range(25)]
    want = [brute(r) for r in raws]
    assert [fp.fingerprint(r) for r in raws] == want
    for block in (7, 64, 1000):
        monkeypatch.setattr(fp, "BLOCK", block)
        assert [fp.fingerprint(r) for r in raws] == want


def test_a_very_long_text_takes_bounded_tables():
    raw = random.Random(4).randbytes(9 << 20)
    tail = fp.fingerprint(raw[: 7 << 20])
    assert fp.likeness(fp.fingerprint(raw), fp.fingerprint(raw[:5000] + b"changed" + raw[5000:])) > 0.9 and tail
    assert all(len(t) <= fp.KEPT for t in fp._TABLES.values())


def test_neighbours(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 10**9), " ".join(rng.choice(["été", "word", "more", f"w{i}"]) for _ in range(rng.randint(0, 90))), "x") for i in range(400)]
    rows += [(3, None, None), (4, "", "y"), (5, "ab\n" * 40_000, "z")]
    rows.sort()
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fp.neighbours(df).collect()}
    assert len(got) == len(rows)
    for k, (d, text, _) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(text.encode()), fp.fingerprint(edited.encode()))
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fp.likeness(r.fingerprint, fp.fingerprint(after.encode()))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "no id"), (7, "same text"), (7, "same text"), (7, None)]
    assert fp.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert fp.neighbours(spark.createDataFrame(rows[:1], "doc_id long, text string")).count() == 1
    assert fp.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
