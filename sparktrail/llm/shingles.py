"""Hashed word shingles of whole texts, vectorised over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import slices
from .fingerprints import BACK, mixed, powers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(64)]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased A-Z, and the number of words before each text (one entry more than texts)."""
    joined = b"\n".join(raws) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=prefix[1:])
    words = (prefix[ends] - prefix[starts]) * powers(len(data), BACK)[starts] + (ends - starts).astype(np.uint64) * _FACTORS[40]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    return mixed(words), np.searchsorted(starts, begins)


def shingle_sets(texts: pa.Array, size: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than `size`: the whole sequence is the one shingle; no words: empty."""
    for lo, hi in slices(texts):
        raws = [(t or "").encode() for t in texts[lo:hi].to_pylist()]
        words, at = word_hashes(raws)
        every = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for k in range(size):
            every += words[k : k + len(every)] * _FACTORS[k]
        every = mixed(every)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                yield mixed(np.array([sum(int(w) * int(_FACTORS[k]) for k, w in enumerate(words[a:b])) + (b - a) * int(_FACTORS[50]) & (1 << 64) - 1], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set only, as signed longs."""
    a = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = mixed(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def leading(s: np.ndarray, most: int, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first `most` members of the set in a fixed order of all shingles: light ones by hash, then heavy ones by weight. `heavy` is sorted."""
    if len(heavy) == 0:
        return s[:most]
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    common = heavy[at] == s
    if not common.any():
        return s[:most]
    light = s[~common]
    if len(light) >= most:
        return light[:most]
    often = s[common]
    return np.concatenate([light, often[np.lexsort((often, weight[at[common]]))]])[:most]


def prefix(s: np.ndarray, percent: int, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first members of the set in the order of `leading`.

    Two sets of similarity >= percent share at least ceil(percent * n / 100) members of each, so their
    prefixes, which leave out one fewer than that, have a member in common. This holds for any order; one
    that puts frequent shingles last keeps the shared members rare."""
    n = len(s)
    return leading(s, n - -(-n * percent // 100) + 1 if n else 0, heavy, weight)


def neighbours(s: np.ndarray, percent: int, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """48-bit hashes of the first pairs of neighbours in the order of `leading`; of single members up to a similarity of 75 percent.

    Texts that have nothing to do with each other share a shingle here and there, the more of them the more texts there are, but
    hardly two that are neighbours in both sets. Of two linked sets, each member that one lacks parts two pairs of neighbours of the
    other and each one it has in addition parts one. With sizes n and x and an overlap of percent * (n + x) / (100 + percent) or more
    these are at most 2 * n * (100 - percent) / 100 pairs, the most where the other set is the smallest one and lies inside. So
    one pair more than that holds the first pair that both sets have, in either of them. Above 75 percent every set of two members
    has as many pairs; a set of one links with equal ones only."""
    n = len(s)
    if percent <= 75:
        return mixed(prefix(s, percent, heavy, weight)) >> np.uint64(16)
    first = leading(s, 2 * n * (100 - percent) // 100 + 2, heavy, weight)
    return mixed(first[:-1] * _FACTORS[41] + first[1:] * _FACTORS[42]) >> np.uint64(16)
