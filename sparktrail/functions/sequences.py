"""Two long sequences: their longest common subsequence, and where they part along one.

A row of the table of lengths is the bits of one integer (a 0 where the length grows; Hyyro). Going back along the table needs
all rows, so about sqrt(n) of them are kept and the rows between two kept ones are made again: for sequences of n and m items
that is n * m / 64 word steps and sqrt(n) * m / 4 bytes."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTING = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("item", pa.string())]))


def _places(b: list) -> dict:
    """item -> bits of its places. Null is equal to nothing."""
    at: dict = {}
    for i, x in enumerate(b):
        if x is not None:
            at.setdefault(x, []).append(i)
    made = {}
    for x, places in at.items():
        bits = bytearray(len(b) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        made[x] = int.from_bytes(bits, "little")
    return made


def _next(row: int, match: int, full: int) -> int:
    both = row & match
    return (row + both | row - both) & full


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    at, full = _places(b), (1 << len(b)) - 1
    row = full
    for x in a:
        row = _next(row, at.get(x, 0), full)
    return len(b) - row.bit_count()


def partings(a: list, b: list, most: int | None = None) -> list[tuple[str, int, str]]:
    """The places where the sequences part, in order; the last `most` of them if given.

    Equal ends are matched; else an item of `a` is left out if that keeps the length, or else one of `b`."""
    at, full = _places(b), (1 << len(b)) - 1
    step = max(1, math.isqrt(len(a)))
    kept, row = [full], full
    for i, x in enumerate(a, 1):
        row = _next(row, at.get(x, 0), full)
        if i % step == 0:
            kept.append(row)
    base, rows = -1, []

    def bits(i: int) -> int:
        nonlocal base, rows
        if i // step != base:
            base = i // step
            rows = [kept[base]]
            for x in a[base * step : (base + 1) * step - 1]:
                rows.append(_next(rows[-1], at.get(x, 0), full))
        return rows[i - base * step]

    def length(row: int, j: int) -> int:
        return j - (row & ((1 << j) - 1)).bit_count()

    i, j, out = len(a), len(b), []
    now = bits(i)
    while (i or j) and (most is None or len(out) < most):
        if not i:
            j -= 1
            out.append(("missing_in_actual", j, b[j]))
            continue
        if j and a[i - 1] is not None and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            now = bits(i)
            continue
        above = bits(i - 1)
        # a row's length falls to the left where its bit is 0; where it doesn't, the rows' lengths decide
        if not j or not now >> (j - 1) & 1 or length(above, j) == length(now, j):
            i -= 1
            now = above
            out.append(("extra_in_actual", i, a[i]))
        else:
            j -= 1
            out.append(("missing_in_actual", j, b[j]))
    return out[::-1]


def common_length(a: Column, b: Column) -> Column:
    """`common` of two array columns, a batch at a time; null if one is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else common(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(a, b)


def parting_places(a: Column, b: Column, most: int | None = None) -> Column:
    """`partings` of two array columns as array<struct<kind, at, item>>, a batch at a time; null if one is null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [None if p is None or q is None else partings(p, q, most) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
        return pa.array([None if f is None else [dict(zip(("kind", "at", "item"), d, strict=True)) for d in f] for f in found], PARTING)

    return F.arrow_udf(run, "array<struct<kind: string, at: int, item: string>>")(a, b)
