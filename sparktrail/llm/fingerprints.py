"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes is taken at every byte. Where it is -1 modulo the block
size a chunk ends, and one base64 character of a hash of the chunk joins the signature; the bytes
after the last end give a last character. Block sizes are 3 * 2^k. The size is the smallest with
size * LENGTH >= bytes, and is halved while its signature has fewer than LENGTH / 2 characters. The
fingerprint is `size:signature:signature at twice the size`. A signature has LENGTH characters at
most; the chunk that would exceed it runs to the end of the text, so every byte counts.

Likeness of fingerprints needs compatible sizes (equal, or one twice the other): signatures of the
same size are compared by edit distance, likeness is 1 - distance / the longer length, and the
better of the pairs counts. Other sizes have likeness 0. Equal fingerprints have likeness 1.

`neighbours` edits each document with the head of the next one in rising doc_id order: rows are
range-partitioned by doc_id on split points, texts compressed, and the first row of each range also
goes to the range before it, so a document meets its successor in one pass over one shuffle.

Defined cases: null text is an empty one, with fingerprint `3::`; null ids come first, equal ids in
order of text; a table of one row is its own successor; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, partitions, splits

WINDOW, LENGTH, SMALLEST = 7, 64, 3
CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PRIME = np.uint64(0x100000001B3)


BACK = pow(int(PRIME), -1, 1 << 64)
#: Bytes of a text that are hashed at a time; tables of powers of more than KEPT entries aren't kept.
BLOCK, KEPT = 1 << 20, 1 << 22
_TABLES: dict[int, np.ndarray] = {}


def powers(n: int, base: int = int(PRIME)) -> np.ndarray:
    """base ** i modulo 2**64 for i < n; doubled as needed, and kept up to KEPT entries."""
    table = _TABLES.get(base, np.ones(1, dtype=np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.array([pow(base, len(table), 1 << 64)], dtype=np.uint64)])
        if len(table) <= KEPT:
            _TABLES[base] = table
    return table[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that lets every bit depend on every other one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the WINDOW bytes up to each byte (fewer at the start), block by block."""
    out = np.empty(len(data), dtype=np.uint32)
    for lo in range(0, len(data), BLOCK):
        first = max(0, lo - WINDOW + 1)
        part = data[first : lo + BLOCK]
        total = np.zeros(len(part), dtype=np.uint32)
        for k in range(min(WINDOW, len(part))):
            total[k:] += (part[: len(part) - k].astype(np.uint32) + np.uint32(1)) * np.uint32(pow(0x01000193, k + 1, 1 << 32))
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
        out[lo : lo + BLOCK] = (total ^ (total >> np.uint32(12)))[lo - first :]
    return out


def sums_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * PRIME ** place of all bytes before each of the rising places, block by block."""
    out, total = np.zeros(len(places), dtype=np.uint64), 0
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK]
        run = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(len(part)))
        a, b = np.searchsorted(places, [lo + 1, lo + len(part) + 1])
        shift = pow(int(PRIME), lo, 1 << 64)
        out[a:b] = run[places[a:b] - lo - 1] * np.uint64(shift) + np.uint64(total)
        total = (total + int(run[-1]) * shift) % (1 << 64)
    return out


def chunk_ends(ends: np.ndarray, n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes end, LENGTH of them at most."""
    cuts = ends[: LENGTH - 1] + 1
    return cuts if len(cuts) and cuts[-1] == n else np.append(cuts, n)


def signature(marks: np.ndarray, sums: np.ndarray, cuts: np.ndarray) -> str:
    """sums: those of `sums_at` at the marks, 0 and all cuts among them. A chunk's difference of sums, moved to place 0 by the inverse power, is its hash."""
    starts, n = np.concatenate([[0], cuts[:-1]]), int(cuts[-1])
    back = powers(n, BACK)[starts] if n <= BLOCK else np.array([pow(BACK, s, 1 << 64) for s in starts.tolist()], dtype=np.uint64)
    hashes = (sums[np.searchsorted(marks, cuts)] - sums[np.searchsorted(marks, starts)]) * back
    return "".join(CODE[i] for i in (mixed(hashes + (cuts - starts).astype(np.uint64)) & np.uint64(63)).tolist())


def fingerprint(raw: bytes) -> str:
    n = len(raw)
    if n == 0:
        return f"{SMALLEST}::"
    data = np.frombuffer(raw, dtype=np.uint8)
    roll = rolling(data)
    size = SMALLEST
    while size * LENGTH < n:
        size *= 2
    ends: dict[int, np.ndarray] = {}

    def at(s: int) -> np.ndarray:
        """Places where the hash is -1 modulo s; those of 2s are among those of s."""
        if s not in ends:
            of = ends.get(s // 2)
            if of is None:
                ends[s] = np.concatenate([lo + np.flatnonzero(roll[lo : lo + BLOCK] % np.uint32(s) == s - 1) for lo in range(0, n, BLOCK)])
            else:
                ends[s] = of[roll[of] % np.uint32(s) == s - 1]
        return ends[s]

    while size > SMALLEST and len(at(size)) + 1 < LENGTH // 2:
        size //= 2
    one, two = chunk_ends(at(size), n), chunk_ends(at(2 * size), n)
    marks = np.unique(np.concatenate([[0], one, two]))
    sums = sums_at(data, marks)
    return f"{size}:{signature(marks, sums, one)}:{signature(marks, sums, two)}"


def distance(a: str, b: str) -> int:
    """Edit distance by bit-parallel columns (Myers, in Hyyro's form)."""
    if not a or not b:
        return len(a) + len(b)
    last, full, places = 1 << (len(a) - 1), (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(same | up) & full, up & same
        score += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | ~(same | plus) & full, plus & same
    return score


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb, best = int(sa), int(sb), 0.0
    pairs = [(a1, b1), (a2, b2)] if sa == sb else [(a2, b1)] if 2 * sa == sb else [(a1, b2)] if sa == 2 * sb else []
    for x, y in pairs:
        if x and y:
            best = max(best, 1 - distance(x, y) / max(len(x), len(y)))
    return best


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = partitions(docs.sparkSession)
    points = splits(docs, "doc_id", parts)
    tie = F.xxhash64("text")
    ids = docs.select("doc_id", bucket(F.col("doc_id"), points).alias("part"), tie.alias("tie"))
    # the first row of each range that has any: at most one for each split point
    firsts = sorted((r.part, r.f.null, r.f.doc_id, r.f.tie) for r in ids.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("null"), "doc_id", "tie")).alias("f")).collect())
    # a range's first row also goes to the range before; the very first one goes to the last as its successor
    guests = {(f[2], f[3]): firsts[k - 1][0] for k, f in enumerate(firsts)}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, sent = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            out = []
            for part, d, t, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "tie", "text")), strict=True):
                raw = (text or "").encode()
                row = (part, 0, d, t, fingerprint(raw), press.compress(raw))
                out.append(row)
                if (to := guests.get((d, t))) is not None and (d, t) not in sent:
                    sent.add((d, t))
                    out.append((to, 1, *row[2:]))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["part", "guest", "doc_id", "tie", "fingerprint", "body"])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_, before = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out = []
            for part, guest, d, fp, body in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "fingerprint", "body")), strict=True):
                text = open_.decompress(body).decode()
                if before and before[0] == part:
                    _, d0, text0, fp0 = before
                    k = len(text0) // 4
                    edited = (text0[: len(text0) - k] + text[:k]).encode()
                    fp1 = fingerprint(edited)
                    out.append((d0, len(text0), hashlib.sha256(edited).hexdigest(), fp0, fp1, likeness(fp0, fp1), likeness(fp0, fp)))
                before = None if guest else (part, d, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    rows = docs.select(bucket(F.col("doc_id"), points).alias("part"), "doc_id", tie.alias("tie"), "text")
    rows = rows.mapInArrow(send, "part int, guest int, doc_id long, tie long, fingerprint string, body binary")
    # more than one equal row may be first of a range, in several tasks; the first guest is enough
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "tie")
    return rows.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
