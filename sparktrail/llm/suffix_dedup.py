"""Removal of repeated 100-byte strings by a sparse suffix array with deep-shallow sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller
id, or earlier in the same one. Only strings that can have a partner are sorted:

1. Equal texts are found by hash; copies behind the first one are repeats from end to end.
2. In every other text each window of LENGTH bytes chooses its anchor, the GRAM bytes of least hash
   in it (leftmost on ties). Equal windows choose alike, so only anchors whose hash comes twice
   matter. About one byte in forty is an anchor. Long texts are taken in slices of windows, so what a
   task holds doesn't grow with them, and places count from the slice.
3. Every such anchor sends its context, the bytes of the windows that chose it, to the task of its
   hash. The contexts of an anchor that comes more than HOT times go by the HALF bytes left or right of it too,
   of which each window holds one side whole. Sorted, equal contexts come together and are one:
   all but the first are repeats, and none of them is kept. The suffixes (windows) of the others are sorted: multikey quicksort by 8-byte words to SHALLOW bytes, then blind tries: each
   remaining group is split at the byte where a member leaves the group's first one, looking at no
   other byte; members that never leave it within LENGTH bytes equal it. Order of position is kept
   inside groups, so a group's first member is its earliest.
4. Runs of repeated windows go back to their documents.

Both passes are arrays over many groups at once, in batches of bounded size.

Defined cases: null text is an empty one; null ids come first; rows of one id come in order of a
hash of their texts, and rows equal in both are one document, each judged alike; texts shorter than
LENGTH lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_sized, slices
from .fingerprints import BACK, mixed, powers

LENGTH, GRAM, SHALLOW = 100, 20, 24
HALF = (LENGTH - GRAM) // 2
#: Windows of a text that are looked at together; anchors that come more often go by their surroundings too.
SLICE, HOT = 1 << 20, 10_000


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, place, hash, first window, last window of each anchor, in order; places count from each text's start."""
    parts, held, out = [], 0, []
    for k, r in enumerate(raws):
        for lo in range(0, len(r) - LENGTH + 1, SLICE):
            parts.append((k, lo, r[lo : lo + SLICE + LENGTH - 1]))
            held += len(parts[-1][2])
            if held >= 2 * SLICE:
                out.append(_anchors(parts))
                parts, held = [], 0
    if parts or not out:
        out.append(_anchors(parts))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `anchors`, of (text, start, bytes) with LENGTH bytes each at least and fewer than 2**24 bytes together. A run of windows of one anchor ends with its part."""
    none = np.zeros(0, dtype=np.int64)
    if not parts:
        return none, none, none.view(np.uint64), none, none
    data = np.frombuffer(b"".join(r for _, _, r in parts), dtype=np.uint8)
    sizes = np.array([len(r) for _, _, r in parts])
    begins = np.cumsum(sizes) - sizes
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=prefix[1:])
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(data), BACK)[: len(data) - GRAM + 1])
    # 40 bits of hash above 24 bits of place: the least value is the least hash, leftmost
    low = np.uint64((1 << 24) - 1)
    value = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    span, step = LENGTH - GRAM + 1, 1
    while 2 * step <= span:
        value = np.minimum(value[:-step], value[step:])
        step *= 2
    value = np.minimum(value[: len(value) - (span - step)], value[span - step :])
    place = np.arange(len(value))
    text = np.repeat(np.arange(len(parts)), sizes)[: len(value)]
    inside = place + LENGTH <= (begins + sizes)[text]
    place, text, chosen = place[inside], text[inside], (value[inside] & low).astype(np.int64)
    opens = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    closes = np.r_[opens[1:], len(place)] - 1
    t = text[opens]
    shift = np.array([lo for _, lo, _ in parts])[t] - begins[t]
    return np.array([k for k, _, _ in parts])[t], chosen[opens] + shift, grams[chosen[opens]], place[opens] + shift, place[closes] + shift


def sort_equal(data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each suffix the index of the first one of its group with the same LENGTH bytes, by deep-shallow sorting."""
    words = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    first = np.arange(len(starts))
    todo, group = first.copy(), groups.astype(np.int64)

    def singles_out(order: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of groups of two or more, in sorted order, and their new group numbers."""
        number = np.cumsum(opens) - 1
        kept = np.bincount(number)[number] > 1
        return order[kept], number[kept]

    # shallow: by one 8-byte word after the other, groups kept together
    for depth in range(0, SHALLOW, 8):
        key = words[starts[todo] + depth].astype(np.uint64)
        order = np.lexsort((key, group))
        key, group = key[order], group[order]
        opens = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])] if len(order) else np.zeros(0, dtype=bool)
        todo, group = singles_out(todo[order], opens)
        if not len(todo):
            return first
    # deep: blind tries, one level of all of them at a time
    depth = np.arange(SHALLOW, LENGTH)
    while len(todo):
        opens = np.r_[True, group[1:] != group[:-1]]
        leader = todo[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        leaves = np.full(len(todo), LENGTH)
        for lo in range(0, len(todo), 50_000):
            a, b = starts[todo[lo : lo + 50_000]], starts[leader[lo : lo + 50_000]]
            differ = data[a[:, None] + depth] != data[b[:, None] + depth]
            any_ = differ.any(axis=1)
            leaves[lo : lo + 50_000] = np.where(any_, SHALLOW + differ.argmax(axis=1), LENGTH)
        same = leaves == LENGTH
        first[todo[same]] = leader[same]
        todo, group, leaves = todo[~same], group[~same], leaves[~same]
        if len(todo):
            byte = data[starts[todo] + leaves].astype(np.int64)
            branch = leaves * 256 + byte
            order = np.lexsort((branch, group))
            branch, group = branch[order], group[order]
            todo, group = singles_out(todo[order], np.r_[True, (branch[1:] != branch[:-1]) | (group[1:] != group[:-1])])
    return first


class Batch:
    """Contexts of many anchor hashes, waiting to be sorted together."""

    def __init__(self):
        self.rows, self.count, self.out = [], 0, []

    def add(self, group: list[tuple[int, int, int, int, bytes]]) -> None:
        """group: (doc, tie, first window, anchor's offset in the context, context) of one key, all contexts unlike."""
        if len(group) < 2:
            return
        fresh = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        # a window reaches HALF bytes left of the anchor, or HALF right of it: contexts alone with both are done
        half = HALF
        left: dict[bytes, int] = {}
        right: dict[bytes, int] = {}
        keys = []
        for r in fresh:
            at, text = r[3], r[4]
            a = text[at - half : at] if at >= half else None
            b = text[at + GRAM : at + GRAM + half] if at - (len(text) - LENGTH) <= half else None
            keys.append((a, b))
            if a is not None:
                left[a] = left.get(a, 0) + 1
            if b is not None:
                right[b] = right.get(b, 0) + 1
        for r, (a, b) in zip(fresh, keys, strict=True):
            windows = len(r[4]) - LENGTH + 1
            border = min(windows, max(0, r[3] - half + 1))  # windows before it reach far left, the others far right
            lo = 0 if a is not None and left[a] > 1 else border
            hi = windows if b is not None and right[b] > 1 else border
            if b is not None and right[b] > 1 and r[3] >= half:
                lo = min(lo, border - 1)  # the window with HALF bytes on both sides
            if hi > lo:
                self.rows.append((self.count, r, lo, hi))
        self.count += 1

    @property
    def windows(self) -> int:
        return sum(hi - lo for _, _, lo, hi in self.rows)

    def flush(self) -> list[tuple[int, int, int, int]]:
        """(doc, tie, start, end) of repeated bytes."""
        out, self.out = self.out, []
        rows, self.rows = self.rows, []
        if rows:
            data = np.frombuffer(b"".join(r[4] for _, r, _, _ in rows) + bytes(8), dtype=np.uint8)
            begins = np.cumsum([0] + [len(r[4]) for _, r, _, _ in rows[:-1]])
            n = np.array([hi - lo for _, _, lo, hi in rows])
            which = np.repeat(np.arange(len(rows)), n)
            window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat([lo for _, _, lo, _ in rows], n)
            offset = np.array([r[3] for _, r, _, _ in rows])[which] - window
            group = np.array([g for g, _, _, _ in rows])[which] * LENGTH + offset
            repeated = sort_equal(data, begins[which] + window, group) != np.arange(len(which))
            edge = np.diff(np.r_[False, repeated, False].astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            # runs end where the next context begins
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                while True:
                    k = which[s]
                    last = min(e, s + int(n[k]) - int(window[s] - rows[k][2]) - 1)
                    _, r, _, _ = rows[k]
                    out.append((r[0], r[1], r[2] + int(window[s]), r[2] + int(window[last]) + LENGTH))
                    if last == e:
                        break
                    s = last + 1
        return out


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of the hashes, as 64-bit words made by an aggregate; only it comes to the driver."""
    at = hashes.select(F.shiftrightunsigned("g", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("flags")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["flags"].to_numpy().view(np.uint64)
    return out


def _has(flags: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold each hash."""
    at = (g >> np.uint64(64 - (len(flags) * 64).bit_length() + 1)).astype(np.int64)
    return (flags[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


#: The bitmap of repeated hashes has 32 bits a hash, and at most 2**28 (32 MB). Beyond, it lets more contexts through, never fewer.
FILTER_BITS = (20, 28)


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], tuple]]:
    texts = batch.column("text")
    for lo, hi in slices(texts):
        raws = [(t or "").encode() for t in texts[lo:hi].to_pylist()]
        yield lo, raws, anchors(raws)


def _sides(g: int, at: int, context: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """key, first window, anchor's offset, context: the windows that hold the HALF bytes left of the anchor, and the others, which hold those right of it."""
    import xxhash

    border = min(len(context) - LENGTH + 1, max(0, at - HALF + 1))
    for side, lo, hi, near in ((b"l", 0, border, context[max(0, at - HALF) : at]), (b"r", border, len(context) - LENGTH + 1, context[at + GRAM : at + GRAM + HALF])):
        if hi > lo:
            key = xxhash.xxh64_intdigest(side + near, seed=g & 0xFFFFFFFFFFFFFFFF)
            yield key - (1 << 64 if key >> 63 else 0), lo, at - lo, context[lo : hi + LENGTH - 1]


def repeats(docs: DataFrame, work: Workspace, hot: int = HOT) -> DataFrame:
    """doc, tie, start, end: repeated bytes of texts, which must be distinct. docs: doc_id, tie, text."""
    spark = docs.sparkSession

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, (_, _, g, _, _) in _each(batch):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])

    twice = work.keep(docs.select("text").mapInArrow(hashes, "g long").groupBy("g").agg(F.count("*").alias("c")).filter("c > 1"), "twice")
    size = twice.agg(F.count("*").alias("n"), F.count_if(F.col("c") > hot).alias("hot")).first()
    bits = [min(max(FILTER_BITS[0], int(32 * n).bit_length()), FILTER_BITS[1]) for n in size]
    bitmap = spark.sparkContext.broadcast((_filter(twice, bits[0]), _filter(twice.filter(F.col("c") > hot), bits[1])))

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, often = bitmap.value
        for batch in batches:
            ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            # of a batch's equal contexts only the earliest travels; the others are repeats for certain (no context, `at` is their end)
            first: dict[tuple[int, int, bytes], tuple] = {}
            out: list[tuple] = []
            for lo, raws, (k, place, g, a, z) in _each(batch):
                hit = np.flatnonzero(_has(flags, g))
                for i, p, h, x, y, split in zip(k[hit].tolist(), place[hit].tolist(), g.view(np.int64)[hit].tolist(), a[hit].tolist(), z[hit].tolist(), _has(often, g[hit]).tolist(), strict=True):
                    d, whole = ids[lo + i], raws[i][x : y + LENGTH]
                    for key_, from_, at, context in _sides(h, p - x, whole) if split else ((h, 0, p - x, whole),):
                        key = (key_, at, context)
                        row = (d is not None, d or 0, ties[lo + i], x + from_)
                        other = first.setdefault(key, row)
                        if other is not row:
                            later = max(row, other)
                            first[key] = min(row, other)
                            out.append((h ^ (later[1] * 0x5851F42D4C957F2D + later[3]) & 0x7FFFFFFF, later[1] if later[0] else None, later[2], later[3], later[3] + len(context), None))
            out += [(h, r[1] if r[0] else None, r[2], r[3], at_, c) for (h, at_, c), r in first.items()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)], ["g", "doc", "tie", "a", "at", "context"])

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, group, now, same = Batch(), [], None, None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc", "tie", "start", "end"])

        held = 0
        for batch in batches:
            for g, doc, tie, a, at, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if context is None:
                    waiting.out.append((doc, tie, a, at))
                    held += 100
                    continue
                if g == now and (at, context) == same:  # of equal contexts the first one stands for all
                    waiting.out.append((doc, tie, a, a + len(context)))
                    held += 100
                    continue
                same = (at, context)
                if g != now:
                    waiting.add(group)
                    held += sum(len(r[4]) for r in group)
                    group, now = [], g
                    if held > 3_000_000:
                        yield result(waiting.flush())
                        held = 0
                group.append((doc, tie, a, at, context))
            if len(waiting.out) > 100_000:  # these are repeats for certain
                rows_, waiting.out = waiting.out, []
                yield result(rows_)
        waiting.add(group)
        yield result(waiting.flush())

    rows = docs.select("doc_id", "tie", "text").mapInArrow(contexts, "g long, doc long, tie int, a int, at int, context binary")
    rows = rows.repartition("g").sortWithinPartitions("g", "at", "context", F.col("doc").asc_nulls_first(), "tie", "a")
    return rows.mapInArrow(resolve, "doc long, tie int, start int, end int")


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    work = Workspace(spark, "suffixes")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    keyed = work.keep(docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), F.octet_length("text").alias("n")), "keys")
    firsts = keyed.groupBy("t1", "t2", "n").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"), F.count("*").alias("c"))
    shared = work.keep(firsts.filter("c > 1").select("t1", "t2", "n", F.col("first.doc_id").alias("first")), "shared")
    copies = join_sized(keyed, shared, ["t1", "t2", "n"], "inner").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = work.keep(copies.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), "t1").distinct(), "copies")
    # rows of one id come in order of their texts' hashes; ids are rarely given twice
    again = keyed.select("doc_id", "t1").distinct().groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy("t1")
    again = keyed.select("doc_id", "t1").distinct().join(again.withColumnRenamed("doc_id", "d2"), F.col("doc_id").eqNullSafe(F.col("d2")), "left_semi").withColumn("tie", F.row_number().over(order).cast("int"))
    again = work.keep(again.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), "t1", "tie"), "again")
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), F.xxhash64("text").alias("t1"), "doc_id", "text")
    rows = rows.withColumn("tie", F.lit(0)) if again.isEmpty() else join_sized(rows, again, ["d", "z", "t1"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    fresh = join_sized(rows.filter(F.octet_length("text") >= LENGTH), copies, ["d", "z", "t1"], "left_anti")
    found = work.keep(repeats(fresh.select("doc_id", "tie", "text"), work, hot), "found")
    spans = found.groupBy(F.coalesce("doc", F.lit(0)).alias("d"), F.col("doc").isNull().alias("z"), "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = rows.select("d", "z", "t1", "doc_id", "tie", "text")
    whole = join_sized(whole, copies.withColumn("copy", F.lit(True)), ["d", "z", "t1"], "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def pressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = [press.compress(b"" if c and len(t.encode()) >= LENGTH else t.encode()) for c, t in zip(batch.column("copy").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            sizes = pa.array([len(t.encode()) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "z", "doc_id", "tie", "copy")), sizes, pa.array(bodies, pa.binary())], ["d", "z", "doc_id", "tie", "copy", "n_bytes", "body"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for copy, n, body, found_ in zip(*(batch.column(c).to_pylist() for c in ("copy", "n_bytes", "body", "spans")), strict=True):
                raw, pieces, at, spans_ = open_.decompress(body), [], 0, 0
                if copy and n >= LENGTH:
                    out.append((n, n, 1, hashlib.sha256(b"").hexdigest()))
                    continue
                for a, b in merged(found_ or []):
                    pieces.append(raw[at:a])
                    at, spans_ = b, spans_ + 1
                kept = b"".join([*pieces, raw[at:]])
                out.append((n, n - len(kept), spans_, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    sent = whole.mapInArrow(pressed, "d long, z boolean, doc_id long, tie int, copy boolean, n_bytes long, body binary")
    joined = sent.join(spans, ["d", "z", "tie"], "left").select("doc_id", "copy", "n_bytes", "body", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
