"""N-gram Jaccard join in the metric space of shingle sets, exact.

Distance is 1 - intersection / union, a metric; documents link at distance <= eps. Beside it stands
the size of the symmetric difference, a metric too: a set has a link only where that is at most
LIMIT(n) = n * (100 - percent) / percent. Folding members to hash classes and counting them (a
histogram under L1) brings no two sets further apart, so triangle windows hold there as well, at a
small part of the bytes.

1. Equal sets are joined by a 128-bit hash first, so a group of copies is one set.
2. Pivots are chosen among the data: of the sets of a size band that share a pair of neighbours among their
   first members (rare members first), the smallest. Most sets are at distance 1 from any pivot, where the
   triangle inequality separates nothing; two linked sets share such a pair (`shingles.neighbours`), so the
   pivots of these groups are those that a set and its links have in common. Single members would be shared by
   chance, the more the more texts there are. Pairs that one set alone has are found by packed keys first, and
   stay where they are. A set near the lower edge of its
   band is replicated to the band below. No group is gathered: its pivot is an aggregate, and its sets
   meet the pivot in a join that AQE splits where it is skewed.
3. In the contracted metric the sets of a pivot fall apart into cells, sets that no chain of possible
   links joins. The smallest set of a cell is its own pivot from there on, and cells of several pivots with
   the same smallest set are one region. A pivot of more than CELL sets is treated by distance alone: sets
   within CLOSE * LIMIT of it stay in its region; each of the others can link with sets of about its own
   distance only: shells around the pivot of width LIMIT, where a set is replicated to the next shell if its
   window reaches there, show whether there is any; if not, it leaves.
4. Voronoi: each set goes to the nearest of its pivots, and is linked to it if their exact distance allows.
5. Regions that still hold sets of different components are joined exactly and recursively. In one task
   two pivots make Voronoi cells, sets with |d1 - d2| <= 2 eps are replicated to both, and cells are
   joined recursively; where cells no longer shrink, pairs that share a member rare in the cell, pass
   the size bound and both triangle bounds and aren't yet connected are compared. A region that one task can't
   hold is split by distributed passes around PIVOTS pivots at a time: chunks of sets meet the pivots, sets
   go to the cell of the nearest one and, within 2 eps, of others; sets linked to a cell's pivot leave it
   unless another one's window reaches them. What passes don't make smaller is joined by pairs of chunks.
   A pair that is already connected needs no comparison, as only components are asked for.

Components are found by distributed star steps. Shingles that are frequent in some task's rows, HEAVY
of them at most, go last in the prefix order; which ones they are changes the work, never the result.
`counts` tells how much each step did.

Defined cases: a text without words, null text included, has no shingles and links with nothing; a
null id links with nothing and has a null component; repeated rows are in one component; rows of one
id are joined each with its own text; an empty table gives an empty result; other columns are
ignored by `join` and passed on by `one_of_each`, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, join_sized, slices
from .components import components
from .fingerprints import mixed
from .shingles import neighbours, set_hash, shingle_sets

#: Frequent shingles kept for the order; seen in so many documents of one task at least.
HEAVY, OFTEN = 200_000, 8
#: Bits of the bitmap of shared keys, at least and at most.
FLAGS = (20, 28)
#: Sets in a region that one task joins; sets in a chunk of a distributed pass; members of all the sets that one task joins.
LOCAL, CHUNK, MEMBERS = 4096, 256, 2_000_000
#: Sets of a pivot that are told apart pair by pair, in the contracted metric.
CELL = 1000
#: Sets of a shell that a task holds (one byte for each two of their members); larger shells stay as they are.
HELD = 50_000
#: Sets within so many limits of a pivot stay in its region at once.
CLOSE = 1.25
#: Pivots of a large region in one pass, and passes before its chunks are joined pair by pair.
PIVOTS, PASSES = 8, 6


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, s1, s2 (a hash of the set), members (sorted hashes, packed)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                made = list(shingle_sets(batch.column("text").slice(lo, hi - lo), size))
                signs = [set_hash(s) for s in made]
                columns = [pa.array([len(s) for s in made], pa.int32()), pa.array([a for a, _ in signs], pa.int64()), pa.array([b for _, b in signs], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], ["doc_id", "n", "s1", "s2", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, members binary")


def unpacked(members: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column of packed ones, without a copy."""
    return (np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in members)


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, sorted, and the weights by which they go last."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column("text"), size):
                kept.append(s)
                held += len(s)
                if held > 2_000_000:
                    yield flush()
                    kept, held = [], 0
        if kept:
            yield flush()

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "shingle").limit(HEAVY).toArrow()
    found = top["shingle"].to_numpy().view(np.uint64) if len(top) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(found)
    return found[order], (top["n"].to_numpy()[order] if len(top) else np.zeros(0, dtype=np.int64))


def classes(n: int) -> int:
    """Hash classes of a set of n members: two to four members a class, and 2,048 classes at most."""
    return 1 << min(11, max(3, (n // 4).bit_length()))


def histogram(s: np.ndarray) -> bytes:
    """Members by hash class, a byte each, or four where one class has more than a byte holds."""
    k = classes(len(s))
    h = np.bincount((s >> np.uint64(65 - k.bit_length())).astype(np.int64), minlength=k)
    return h.astype(np.uint8 if h.max(initial=0) < 256 else "<u4").tobytes()


def folded(raw, n: int, k: int) -> np.ndarray:
    """The histogram of a set of n members over k classes, no more than its own."""
    own = classes(n)
    h = np.frombuffer(raw, dtype=np.uint8 if len(raw) == own else "<u4")
    return h.reshape(k, own // k).sum(axis=1, dtype=np.int32) if own > k else h.astype(np.int32)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (a hash of the set), first (the keys of its first neighbours, packed), hist."""
    heavy = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))
    names = ["doc_id", "n", "s1", "s2", "first", "hist"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = heavy.value
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                n, signs, firsts, hists = [], [], [], []
                for s in shingle_sets(batch.column("text").slice(lo, hi - lo), size):
                    n.append(len(s))
                    signs.append(set_hash(s))
                    firsts.append(packed(neighbours(s, percent, keys, weights)))
                    hists.append(histogram(s))
                columns = [pa.array(n, pa.int32()), pa.array([a for a, _ in signs], pa.int64()), pa.array([b for _, b in signs], pa.int64()), pa.array(firsts, pa.binary()), pa.array(hists, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, first binary, hist binary")


def _band(n: Column, percent: int) -> Column:
    """Size bands, four links wide; the base is a little above a link's ratio, so a link never skips a band."""
    return F.floor(F.log(n.cast("double")) / (4 * math.log(100 / percent) * (1 + 1e-9))).cast("int")


def _with_window(n: Column, percent: int) -> Column:
    """A set's band, and the band of the smallest set it could link with where that is another one."""
    return F.array_distinct(F.array(_band(n, percent), _band(F.ceil(n * percent / 100), percent)))


def packed(keys: np.ndarray) -> bytes:
    """48-bit keys, six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def keys_of(raws: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _banded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows (first, band), told apart by band, and how many each row has."""
    raws = batch.column("first").to_pylist()
    many = np.array([len(r) // 6 for r in raws], dtype=np.int64)
    bands = np.repeat(batch.column("band").to_numpy().astype(np.uint64), many)
    return mixed(keys_of(raws) ^ (bands << np.uint64(48))) >> np.uint64(16), many


def shared_keys(rows: DataFrame, total: int, work: Workspace) -> np.ndarray:
    """A bitmap of the keys that rows (first, band) have twice or more, of 2**28 bits (32 MB) at most: where it is crowded it lets more keys through.

    A batch's keys are dealt out packed, by ranges of about a quarter of a million keys, so each key travels at six bytes; total: members of all sets."""
    parts = min((total // 500_000).bit_length(), FLAGS[0] - 6)
    bits = min(max(FLAGS[0], (8 * total).bit_length()), FLAGS[1])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(_banded(batch)[0])
            keys = keys[np.append(True, keys[1:] != keys[:-1]) | np.append(True, np.append(True, keys[2:] != keys[:-2])[: len(keys) - 1])] if len(keys) else keys  # twice are enough
            cuts = np.searchsorted(keys, np.arange(1 << parts, dtype=np.uint64) << np.uint64(48 - parts)).tolist() + [len(keys)]
            full = [(k, packed(keys[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int32()), pa.array([x for _, x in full], pa.binary())], ["part", "keys"])

    def find(table: pa.Table) -> pa.Table:
        keys = np.sort(keys_of(table["keys"].to_pylist()))
        at = np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(48 - bits)).astype(np.int64)
        word, first = np.unique(at >> 6, return_index=True)
        flags = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, dtype=np.uint64)
        return pa.table({"word": pa.array(word, pa.int64()), "flags": pa.array(flags.view(np.int64), pa.int64())})

    dealt = rows.select("first", "band").mapInArrow(deal, "part int, keys binary")
    found = work.keep(dealt.groupBy("part").applyInArrow(find, "word long, flags long"), "flags").toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[found["word"].to_numpy()] = found["flags"].to_numpy().view(np.uint64)
    return out


def near_pivots(sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """p, x, n: each set with the pivots of its groups, pivots with themselves too. Keys that one set alone has don't travel."""
    rows = sets.withColumn("band", F.explode(_with_window(F.col("n"), percent)))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bitmap = sets.sparkSession.sparkContext.broadcast(shared_keys(rows, total, work))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bitmap.value
        for batch in batches:
            keys, many = _banded(batch)
            at = (keys >> np.uint64(48 - (len(flags) * 64).bit_length() + 1)).astype(np.int64)
            hit = np.flatnonzero(flags[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            row = np.repeat(np.arange(len(many)), many)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), batch.column("n").take(pa.array(row)), batch.column("rep").take(pa.array(row))], ["k", "n", "x"])

    # groups whose keys collide are one: more work, no other result
    rows = work.keep(rows.select("first", "band", "n", "rep").mapInArrow(run, "k long, n int, x long"), "shared")
    lead = rows.groupBy("k").agg(F.min(F.struct("n", "x")).alias("m"), F.count("*").alias("c")).filter("c > 1")
    lead = work.keep(lead.select("k", F.col("m.x").alias("p")), "lead")
    return rows.join(lead.hint("merge"), "k").select("p", "x", "n").distinct()


def cells(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """p, x, h: the cells of pivots with few sets, by their own pivots. near: p, x, n."""
    by = Window.partitionBy("p").orderBy("n", "x")
    # first by size alone: sets without a neighbour that a link could span leave
    below, above = F.lag("n").over(by), F.lead("n").over(by)
    near = near.withColumn("_k", F.coalesce(below * 100 >= percent * F.col("n"), F.lit(False)) | F.coalesce(F.col("n") * 100 >= percent * above, F.lit(False))).filter("_k").select("p", "x", "n")

    def part(xs: list[int], ns: list[int], hists: list) -> Iterator[tuple[int, int, int]]:
        order = sorted(range(len(xs)), key=lambda i: (ns[i], xs[i]))
        k = min(map(classes, ns))
        n = [ns[i] for i in order]
        h = np.stack([folded(hists[i].as_buffer(), ns[i], k) for i in order])
        lead = list(range(len(n)))

        def root(i: int) -> int:
            while lead[i] != i:
                lead[i] = lead[lead[i]]
                i = lead[i]
            return i

        for i in range(len(n)):
            last = bisect.bisect_right(n, n[i] * 100 // percent)
            if last > i + 1:
                for j in (i + 1 + np.flatnonzero(np.abs(h[i + 1 : last] - h[i]).sum(axis=1) <= n[i] * (100 - percent) // percent)).tolist():
                    a, b = sorted((root(i), root(j)))
                    lead[b] = a
        members: dict[int, list[int]] = {}
        for i in range(len(n)):
            members.setdefault(root(i), []).append(i)
        for a, cell in members.items():
            if len(cell) > 1:
                yield from ((xs[order[a]], xs[order[i]], int(np.abs(h[i] - h[a]).sum())) for i in cell)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            out: list[tuple] = []
            for p, x, n, hist in zip(*(batch.column(c).to_pylist() for c in ("p", "x", "n")), batch.column("hist"), strict=True):
                if p != now:
                    out += part(*held) if len(held[0]) > 1 else ()
                    now, held = p, ([], [], [])
                for column, value in zip(held, (x, n, hist), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["p", "x", "h"])
        out = list(part(*held)) if len(held[0]) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["p", "x", "h"])

    rows = near.join(sets.select(F.col("rep").alias("x"), "n", "hist"), ["x", "n"]).select("p", "x", "n", "hist")
    return rows.repartition("p").sortWithinPartitions("p").mapInArrow(run, "p long, x long, h int").groupBy("p", "x").agg(F.min("h").alias("h"))


def contracted(near: DataFrame, sets: DataFrame) -> DataFrame:
    """p, x, n, h (distance to the pivot over the pivot's classes), hist (over these classes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            hs, kept = [], []
            for p, n, pn, a, b in zip(*(batch.column(c).to_pylist() for c in ("p", "n", "pn")), batch.column("hist"), batch.column("ph"), strict=True):
                k = classes(pn)
                if p not in own:
                    own = {p: folded(b.as_buffer(), pn, k)}
                f = folded(a.as_buffer(), n, k)
                hs.append(int(np.abs(f - own[p]).sum()))
                kept.append(np.minimum(f, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x"), batch.column("n"), pa.array(hs, pa.int32()), pa.array(kept, pa.binary())], ["p", "x", "n", "h", "hist"])

    rows = near.join(sets.select(F.col("rep").alias("x"), "n", "hist"), "x")
    rows = rows.join(sets.select(F.col("rep").alias("p"), F.col("n").alias("pn"), F.col("hist").alias("ph")), "p")
    return rows.select("p", "x", "n", "pn", "hist", "ph").mapInArrow(run, "p long, x long, n int, h int, hist binary")


def near_pairs(n: np.ndarray, hist: np.ndarray, percent: int, step: int = 512) -> np.ndarray:
    """Whether each set could link with some other one, by size and by the distance of histograms (a lower bound).

    Sets go by size, so partners are neighbours; a set's search ends with the first one found."""
    order = np.argsort(n, kind="stable")
    n, hist, out = n[order], hist[order].astype(np.int32), np.zeros(len(n), dtype=bool)
    first = np.searchsorted(n, -(-n * percent // 100))
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for k in range(len(n)):
        a = b = k
        while not out[k] and (a > first[k] or b + 1 < last[k]):
            for lo, hi in ((max(first[k], a - step), a), (b + 1, min(last[k], b + 1 + step))):
                if hi > lo and not out[k]:
                    least = np.minimum(n[k], n[lo:hi])
                    ok = np.abs(hist[lo:hi] - hist[k]).sum(axis=1) <= least * (100 - percent) // percent
                    out[lo:hi] |= ok
                    out[k] = ok.any()
            a, b = max(first[k], a - step), min(last[k] - 1, b + step)
    back = np.zeros(len(n), dtype=bool)
    back[order] = out
    return back


def shells(rows: DataFrame, percent: int) -> DataFrame:
    """p, x: sets that could link with another one of their shell or the next. rows: as `contracted`."""

    def keep(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) > HELD:
            return [(r[0], r[3]) for r in rows]
        kept = near_pairs(np.array([r[4] for r in rows], dtype=np.int64), np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8).reshape(len(rows), -1), percent)
        return [(r[0], r[3]) for r, k in zip(rows, kept.tolist(), strict=True) if k]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += keep(held)
                    held = []
                if len(held) > HELD:  # known to be large: passes on at once
                    out.append((row[0], row[3]))
                    continue
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["p", "x"])
        out = keep(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["p", "x"])

    # the width of a band's shells is the limit of its largest set; links lie in one band or one below
    rows = rows.withColumn("band", F.explode(_with_window(F.col("n"), percent)))
    width = F.greatest(F.lit(1.0), F.exp((F.col("band") + 1) * (4 * math.log(100 / percent) * (1 + 1e-9))) * (100 - percent) / percent)
    reach = F.col("h") + F.col("n") * (100 - percent) / percent
    rows = rows.withColumn("shell", F.explode(F.array_distinct(F.array(F.floor(F.col("h") / width), F.floor(reach / width)))))
    rows = rows.select("p", "band", "shell", "x", "n", "hist")
    return rows.repartition("p", "band", "shell").sortWithinPartitions("p", "band", "shell", "x").mapInArrow(run, "p long, x long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def sharing(cell: list[int], sets: list[np.ndarray], percent: int, root) -> Iterator[tuple[int, int]]:
    """Pairs of a cell that share a member of their prefixes, in the cell's own order: members that are rare in it first."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((place, count[place], owner))
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    rank = np.arange(len(every)) - first[owner[order]]
    most = size - -(-size * percent // 100) + 1
    kept = order[(rank < most[owner[order]]) & (count[place[order]] > 1)]
    kept = kept[np.argsort(place[kept], kind="stable")]
    cuts = np.flatnonzero(np.diff(place[kept])) + 1
    seen = set()
    for part in np.split(owner[kept], cuts):
        by_root: dict[int, list[int]] = {}
        for k in part.tolist():
            by_root.setdefault(root(cell[k]), []).append(cell[k])
        # pairs of one component are never looked at; the largest one comes last, so each of its sets meets the others only
        groups = sorted(by_root.values(), key=len)
        for g, here in enumerate(groups[:-1]):
            for there in groups[g + 1 :]:
                for i in here:
                    for j in there:
                        pair = (i, j) if i < j else (j, i)
                        if pair not in seen:
                            seen.add(pair)
                            if root(i) != root(j):
                                yield pair


def join_region(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the region connects; `known` names the components that are connected already."""
    eps = 1 - percent / 100 + 1e-9
    leads: dict[int, int] = {}
    parent = [leads.setdefault(c, i) for i, c in enumerate(known)] if known else list(range(len(ids)))
    links = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def distance(i: int, j: int) -> float:
        n = common(sets[i], sets[j])
        union = len(sets[i]) + len(sets[j]) - n
        if n * 100 >= percent * union and root(i) != root(j):
            links.append((ids[i], ids[j]))
            parent[root(j)] = root(i)
        return 1 - n / union if union else 0.0

    todo = [list(range(len(ids)))]
    while todo:
        cell = todo.pop()
        if len(cell) < 2 or len({root(i) for i in cell}) == 1:
            continue
        first = cell[0]
        d1 = {i: distance(first, i) if i != first else 0.0 for i in cell}
        second = max(cell, key=lambda i: d1[i])
        d2 = {i: distance(second, i) if i != second else 0.0 for i in cell}
        one = [i for i in cell if d1[i] - d2[i] <= 2 * eps]
        two = [i for i in cell if d2[i] - d1[i] <= 2 * eps]
        if len(cell) > 8 and max(len(one), len(two)) < 0.9 * len(cell):
            todo += [one, two]
            continue
        # no split: compare what shares a rare member, passes the sizes and both triangle bounds, and isn't yet connected
        for i, j in sharing(cell, [sets[i] for i in cell], percent, root):
            a, b = len(sets[i]), len(sets[j])
            if root(i) != root(j) and abs(d1[i] - d1[j]) <= eps and abs(d2[i] - d2[j]) <= eps and min(a, b) * 100 >= percent * max(a, b):
                distance(i, j)
    return links


def to_pivot(homes: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """a, b: links of sets to their nearest pivots. homes: p, x. The two sets of a row meet in joins, which AQE splits where a pivot has many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(unpacked(batch.column("pm")), unpacked(batch.column("members")), strict=True):
                n = common(a, b)
                linked.append(100 * n >= percent * (len(a) + len(b) - n))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    rows = homes.join(vectors, "x").join(vectors.select(F.col("x").alias("p"), F.col("members").alias("pm")), "p")
    return rows.select(F.col("p").alias("a"), F.col("x").alias("b"), "pm", "members").mapInArrow(run, "a long, b long")


def _local(regions: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """a, b: links of small regions, one task a region."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["x"].to_pylist(), table["root"].to_pylist(), table["members"].to_pylist(), strict=True))
        links = join_region([r[0] for r in rows], [np.frombuffer(r[2], dtype=np.uint64) for r in rows], percent, [r[1] for r in rows])
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return regions.select("region", "x", "root").join(vectors, "x").groupBy("region").applyInArrow(run, "a long, b long")


def _split(regions: DataFrame, vectors: DataFrame, percent: int, work: Workspace, name: str, turn: int) -> tuple[DataFrame, DataFrame]:
    """One distributed pass over large regions: links to their pivots, and the cells that remain. regions: region, x, root."""
    picks = [F.min(F.struct(F.xxhash64(F.lit(100 * turn + j), "x").alias("_o"), F.col("x").alias("pivot")))["pivot"].alias(f"_{j}") for j in range(PIVOTS)]
    pivots = regions.groupBy("region").agg(F.count("*").alias("c"), *picks)
    # a region's rows meet its pivots in chunks, so no task holds a whole region
    rows = regions.join(pivots.select("region", "c"), "region").withColumn("chunk", F.pmod(F.xxhash64("x"), F.ceil(F.col("c") / CHUNK)).cast("int"))
    named = pivots.select("region", F.explode(F.array_distinct(F.array(*[f"_{j}" for j in range(PIVOTS)]))).alias("pivot"))
    lead = rows.select("region", "chunk").distinct().join(named.join(vectors.withColumnRenamed("x", "pivot"), "pivot"), "region")
    lead = lead.select("region", "chunk", F.lit(None).cast("long").alias("x"), "pivot", "members")
    rest = rows.join(vectors, "x").select("region", "chunk", "x", F.lit(None).cast("long").alias("pivot"), "members")
    eps = 1 - percent / 100 + 1e-9

    def run(table: pa.Table) -> pa.Table:
        xs, ps = table["x"].to_pylist(), table["pivot"].to_pylist()
        members = [np.frombuffer(m, dtype=np.uint64) for m in table["members"].to_pylist()]
        leads = sorted((p, k) for k, p in enumerate(ps) if p is not None)
        out = []
        for k, x in enumerate(xs):
            if x is None:
                continue
            found = []
            for p, j in leads:
                n = common(members[j], members[k])
                union = len(members[j]) + len(members[k]) - n
                found.append((1 - n / union, p, n * 100 >= percent * union))
            least = min(found)[0]
            out += [(x, p, d, linked, d <= least + 2 * eps) for d, p, linked in found if linked or d <= least + 2 * eps]
        region = table["region"][0].as_py()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_())
        return pa.table([pa.array([region] * len(out), pa.int64()), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["region", "x", "pivot", "d", "linked", "inside"])

    near = work.keep(lead.unionByName(rest).groupBy("region", "chunk").applyInArrow(run, "region long, x long, pivot long, d double, linked boolean, inside boolean"), f"{name}-d")
    links = work.keep(near.filter("linked AND pivot <> x").select(F.col("pivot").alias("a"), F.col("x").alias("b")), f"{name}-links")
    cells = near.filter("inside")
    far = cells.filter("NOT linked").groupBy("region", "pivot").agg(F.min("d").alias("least"))
    left = cells.join(far, ["region", "pivot"]).filter(~F.col("linked") | (F.col("d") >= F.col("least") - eps))
    return links, work.keep(left.select(F.xxhash64("region", "pivot", F.lit(turn)).alias("region"), "x", F.col("x").alias("root")), f"{name}-left")


def _by_chunks(regions: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """a, b: links of regions that pivots don't make smaller, by pairs of chunks."""
    counts = regions.groupBy("region").agg(F.ceil(F.count("*") * 2 / LOCAL).cast("int").alias("m"))
    rows = regions.join(counts, "region").withColumn("i", F.pmod(F.xxhash64(F.lit(3), "x"), F.col("m")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select(F.xxhash64("region", F.least("i", "j"), F.greatest("i", "j")).alias("region"), "x", "root")
    return _local(rows.distinct(), vectors, percent)


def _within(regions: DataFrame, vectors: DataFrame, sizes: DataFrame, percent: int, work: Workspace, name: str) -> DataFrame:
    """a, b: links that connect what each region connects. regions: region, x, root. sizes: x, n."""
    found, k = [], 0
    while True:
        counts = regions.join(sizes, "x").groupBy("region").agg(F.count("*").alias("c"), F.sum("n").alias("e")).filter("c > 1")
        counts = work.keep(counts.select("region", (F.col("c").between(2, LOCAL) & (F.col("e") <= MEMBERS)).alias("small")), f"{name}-counts-{k}")
        small = regions.join(counts.filter("small").select("region"), "region", "left_semi")
        found.append(work.keep(_local(small, vectors, percent), f"{name}-links-{k}"))
        if counts.filter("not small").isEmpty():
            break
        large = work.keep(regions.join(counts.filter("not small").select("region"), "region", "left_semi"), f"{name}-large-{k}")
        if k == PASSES:
            found.append(work.keep(_by_chunks(large, vectors, percent), f"{name}-chunks"))
            break
        links, regions = _split(large, vectors, percent, work, f"{name}-pass-{k}", k)
        found.append(links)
        k += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _distinct(sign: DataFrame, copies: DataFrame) -> DataFrame:
    """rep, n, first, hist: each set once. Where few sets have copies only these are gathered, else all are."""
    same, one = ["n", "s1", "s2"], [F.min("doc_id").alias("rep"), F.first("first").alias("first"), F.first("hist").alias("hist")]
    if copies.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return sign.groupBy(*same).agg(*one).select("rep", "n", "first", "hist")
    copies = F.broadcast(copies.select(*same))
    again = sign.join(copies, same, "left_semi").groupBy(*same).agg(*one)
    return sign.join(copies, same, "left_anti").withColumnRenamed("doc_id", "rep").select("rep", "n", "first", "hist").unionByName(again.select("rep", "n", "first", "hist"))


def join(docs: DataFrame, size: int = 3, percent: int = 90, counts: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id. `counts`, if given, is filled with what the steps did."""
    work = Workspace(docs.sparkSession, "jaccard")

    def told(**tables: DataFrame) -> None:
        if counts is not None:
            counts.update({k: t.count() for k, t in tables.items()})

    docs = docs.select("doc_id", "text")
    sign = work.keep(signatures(docs, size, percent), "signatures")
    every = work.keep(sign.drop("first", "hist"), "keys")
    reps = work.keep(every.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "reps")
    sets = work.keep(_distinct(sign.filter("n > 0 AND doc_id IS NOT NULL"), reps.filter("c > 1")), "sets")
    work.drop("signatures")
    near = work.keep(near_pivots(sets, percent, work), "near")
    work.drop("lead", "shared", "flags")
    large = work.keep(near.groupBy("p").agg(F.count("*").alias("c")).filter(F.col("c") > CELL).select("p"), "large")
    regions = cells(join_sized(near, large, "p", "left_anti"), sets, percent)
    told(near=near, large=large)
    if not large.isEmpty():
        around = work.keep(contracted(join_sized(near.select("p", "x"), large, "p", "left_semi"), sets), "around")
        limit = F.col("n") * (100 - percent) / percent
        close = around.filter(F.col("h") <= CLOSE * limit).select("p", "x", "h")
        # a link of a set beyond CLOSE limits is itself beyond CLOSE - 1 of them, and sizes differ by percent at most
        outside = around.filter(F.col("h") > 0.99 * (CLOSE - 1) * percent / 100 * limit)
        kept = work.keep(shells(outside, percent).distinct(), "shells")
        told(shells=kept)
        kept = kept.join(around.select("p", "x", "h"), ["p", "x"])
        regions = regions.unionByName(close.unionByName(kept).groupBy("p", "x").agg(F.min("h").alias("h")))
    regions = work.keep(regions.groupBy("p", "x").agg(F.min("h").alias("h")), "regions")
    work.drop("sets", "near", "around", "shells")
    alone = regions.groupBy("p").agg(F.count("*").alias("c"))
    regions = work.keep(regions.join(alone.filter("c > 1"), "p"), "regions-2")
    told(regions=alone.filter("c > 1"), kept=regions)
    ids = regions.select("x").distinct()
    wanted = work.keep(reps.select(F.col("rep").alias("x"), "n", "s1", "s2").join(ids, "x", "left_semi"), "wanted")
    # of the rows of an id, one of those whose set it stands for; an id with two texts may stand for two sets
    vectors = sets_of(join_sized(docs, work.keep(wanted.select(F.col("x").alias("doc_id")).distinct(), "wanted-ids"), "doc_id", "left_semi"), size)
    vectors = join_sized(vectors.withColumnRenamed("doc_id", "x"), wanted, ["x", "n", "s1", "s2"], "left_semi")
    if not reps.filter("c > 1").isEmpty():
        vectors = vectors.groupBy("x", "n", "s1", "s2").agg(F.first("members").alias("members"))
    vectors = work.keep(vectors.select("x", "members"), "vectors")
    sizes = wanted.select("x", "n")
    # Voronoi: first each set and the nearest of its pivots; then only regions whose sets aren't in one component yet
    homes = work.keep(regions.filter("p <> x").groupBy("x").agg(F.min(F.struct("h", "p")).alias("m")).select("x", F.col("m.p").alias("p")), "homes")
    links = work.keep(to_pivot(homes, vectors, percent), "home-links")
    roots = components(links, work, "first")
    named = regions.select(F.col("p").alias("region"), "x", "c").join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    # a region of two whose other set has its pivot for home is settled
    named = named.join(homes.select("x", F.col("p").alias("home")), "x", "left")
    open_ = named.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("c").alias("c"), F.max((F.col("home") == F.col("region")).cast("int")).alias("met"))
    open_ = open_.filter("lo <> hi AND NOT (c = 2 AND coalesce(met, 0) = 1)").select("region")
    rest = work.keep(named.join(open_, "region", "left_semi").select("region", "x", "root"), "rest")
    inner = _within(rest, vectors, sizes, percent, work, "rest")
    told(homes=homes, home_links=links, rest=rest, rest_links=inner)
    links = work.keep(inner.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")
    roots = components(links, work, "all")
    copies = reps.filter("c > 1").select("n", "s1", "s2", "rep")
    out = join_sized(every, work.keep(copies, "copies"), ["n", "s1", "s2"], "left")
    out = out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("node"))
    out = join_sized(out, roots, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each component (the smallest id); columns as given. Of equal rows one stays."""
    work = Workspace(docs.sparkSession, "jaccard-kept")
    found = work.keep(join(docs, size, percent), "found")
    gone = work.keep(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    twice = work.keep(found.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 AND doc_id IS NOT NULL").select("doc_id"), "twice")
    kept = join_sized(docs, gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return kept
    # the row travels whole in one column, so no name of its own can clash with ours
    again = join_sized(kept, twice, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("_row"), "doc_id", F.xxhash64("text").alias("_t"))
    again = again.dropDuplicates(["doc_id", "_t"]).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return join_sized(kept, twice, "doc_id", "left_anti").unionByName(again)
