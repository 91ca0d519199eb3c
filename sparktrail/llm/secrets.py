"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that match none.

Base spans come from three patterns (`assign`, `access`, `hex`), leftmost and non-overlapping for
each kind; matches that are too short are dropped after matching, as they use up their text.

The rest of every maximal run of A-Z a-z 0-9 + / _ = - outside the base spans is a candidate where at
least SHORT characters of it are left. Its encoding is inferred as the narrowest alphabet that holds it (decimal,
hex, base32, lower case with digits, base62, base64). Three tests ask whether it looks drawn
uniformly from that alphabet: chi-squared uniformity over classes of the alphabet, Wald-Wolfowitz
runs about the median symbol, and lag-one serial correlation; the smallest of their p-values, times
three, must stay above ALPHA. Against words and identifiers speaks the likelihood ratio of the
uniform model to a letter-frequency model; by Markov's inequality exp(-ratio) is a valid p-value,
and the ratio grows with length, so short tokens must be the clearer; letters of one case (the first
one may be a capital) are a word below WORD characters. Benjamini-Hochberg over all
the candidates of a document at rate FDR then decides. What is found is reported as kind `random`.

Defined cases: a null text is an empty one and has no spans; repeated rows get the same answer
each; an empty table gives an empty result; other columns are ignored by `scan` and passed on by
`redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can't hide a longer one
SHORT, WORD = 12, 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT},}}")
ALPHA, FDR = 1e-4, 0.01
ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "-0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
    ("any", "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
]
#: Letters of written English by frequency, in percent.
LETTERS = {"a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4, "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074}


def prose_cost(token: str) -> float:
    """Minus log likelihood under the plain model: letters by frequency, class changes dear, separators cheap.

    A character continues the class of the one before it with probability 0.9."""
    cost, before = 0.0, ""
    for c in token:
        kind = "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s"
        change = kind != before and before not in ("", "s") and kind != "s" and not (before == "u" and kind == "l")
        cost -= math.log(0.1 / 3 if change else 0.9 if before else 0.25)
        cost -= math.log(LETTERS[c.lower()] / 100 * 0.98 + 0.02 / 26) if kind in "lu" else math.log(0.1) if kind == "d" else math.log(0.2)
        before = kind
    return cost


def chi_squared_tail(x: float, k: int) -> float:
    """P(X >= x) for k degrees of freedom, by Wilson and Hilferty's cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, alphabet: str) -> float:
    """The combined p-value of the three tests under uniformity."""
    place = {c: i for i, c in enumerate(alphabet)}
    x, n, size = [place[c] for c in token], len(token), len(alphabet)
    classes = max(2, min(size, n // 5))
    seen = [0] * classes
    for v in x:
        seen[v * classes // size] += 1
    want = [0] * classes
    for v in range(size):
        want[v * classes // size] += 1
    chi = chi_squared_tail(sum((o - n * w / size) ** 2 / (n * w / size) for o, w in zip(seen, want, strict=True)), classes - 1)
    high = [2 * v >= size for v in x]
    a, runs = sum(high), 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        run = two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        run = 0.0
    mid = sum(x) / n
    square = sum((v - mid) ** 2 for v in x)
    serial = two_sided(sum((p - mid) * (q - mid) for p, q in zip(x, x[1:], strict=False)) / square * math.sqrt(n)) if square else 0.0
    return min(1.0, 3 * min(chi, run, serial))


def randomness(token: str) -> float | None:
    """A p-value against `token` being prose or an identifier, or None if it doesn't look random at all."""
    core = token.rstrip("=")
    if len(core) < SHORT or (len(core) < WORD and core.isalpha() and (core[1:].islower() or core.isupper())):
        return None
    alphabet = next(a for _, a in ALPHABETS if not set(core) - set(a))
    if battery(core, alphabet) < ALPHA:
        return None
    return min(1.0, math.exp(min(0.0, len(core) * math.log(len(alphabet)) - prose_cost(core))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of runs outside the base spans (sorted by start), of SHORT characters or more; both lists are walked once."""
    k, end = 0, 0  # spans before k are done; `end` is the furthest end among them
    for m in RUN.finditer(text):
        at, stop = m.span()
        while k < len(base) and base[k][0] < stop:
            if base[k][0] - max(at, end) >= SHORT:
                yield max(at, end), base[k][0]
            end = max(end, base[k][2])
            k += 1
        if stop - max(at, end) >= SHORT:
            yield max(at, end), stop


def random_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    tried, count = [], 0
    for a, b in outside(text, base):
        count += 1
        if (p := randomness(text[a:b])) is not None:
            tried.append((p, a, b))
    tried.sort()
    passed = max((k for k, (p, _, _) in enumerate(tried, 1) if p <= FDR * k / count), default=0)
    return [(a, 3, b) for _, a, b in tried[:passed]]


def spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = spans(text.as_py() or "")
                counts = [sum(k == i for _, k, _ in every) for i in range(4)]
                rows.append((*counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), counts[3]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def masked(text: str, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for a, _, b in spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents, secrets masked and n_chars brought up to date; columns as given."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [None if t is None else masked(t) for t in old]
            batch = batch.set_column(names.index("text"), "text", pa.array(new, batch.schema.field("text").type))
            if "n_chars" in names:
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), old, new, strict=True)]
                batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(sizes, batch.schema.field("n_chars").type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
