"""Phrase collocations from depth-limited count tries.

1. Shards: a task turns texts into word numbers of its own and counts all runs of up to `longest` words. Words are
   numbered in byte order and a run is packed into one integer, so the sorted distinct integers with their counts are the
   trie in preorder. A shard ends at WORDS words; its trie is written as sorted pieces of at most NODES nodes.
2. Ranges: some pieces' first paths give the borders of prefix ranges (they only deal out work). A piece is cut at the
   borders; a node that is a prefix of a later border goes to that range too, as every walk needs its ancestors.
3. Merge: each range reads its pieces in the order of their first paths, so only pieces that overlap are held (a k-way
   merge); equal paths are added up. Nodes with fewer than `least` occurrences can't be parts of a candidate and go.
4. Walk: the merged trie is walked in preorder, where a stack holds the ancestors: the counts of all left parts.
5. Suffix links: a node is joined with its path without the first word, `longest` - 1 times: the counts of right parts.

Defined cases: a null or empty text has no words; null is the language `und`; words may be of any length and hold any
character but the separators; repeated rows count as often as they come; equal scores go by count, then by phrase in byte
order; an empty table gives no rows; other columns are ignored. A very long text may go over several shards: the last
words of one begin the next, where runs that start with them are counted.
"""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_sized, partitions

#: Words of a shard, nodes and bytes of a written piece of a trie, nodes that a merge holds beyond what overlaps.
WORDS, NODES, PIECE_BYTES, HELD = 2_000_000, 2048, 4 << 20, 1 << 19
#: Nodes of a range, how many first paths the driver looks at to place the borders, of how many bytes each, and how many borders there are at most.
RANGE_NODES, FIRSTS, FIRST_BYTES, MOST_RANGES = 1 << 19, 32_768, 128, 2048
#: Bytes that break phrases, and bytes between words (fixed by the rule of words).
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Never a byte of UTF-8: stands for a break.
BREAK = b"\xff"
#: Bits of a word's number in a packed path; three fit 63 bits, and WORDS fits one.
BITS = 21
#: Characters of a text that are turned into words at once.
PART = 1 << 20


def _tables() -> tuple[bytes, bytes]:
    """Lower case, blanks to spaces, breaks to BREAK; bytes 0 to 8 move up by one, as tabs are gone, so that 0 can stand between words. And back."""
    to, back = list(range(256)), list(range(256))
    for b in range(9):
        to[b], back[b + 1] = b + 1, b
    for b in range(ord("A"), ord("Z") + 1):
        to[b] = b + 32
    for b in BLANKS:
        to[b] = 0x20
    for b in BREAKS:
        to[b] = BREAK[0]
    back[0] = 0x20
    return bytes(to), bytes(back)


TO, BACK = _tables()


class Shard:
    """Word numbers of one language until its trie is made."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.numbers[BREAK] = 0
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))

    def trie(self, longest: int, ahead: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """Words in byte order, packed paths in preorder, their counts, and how many words there were. The last `ahead` words start no run."""
        words = sorted(self.numbers)[:-1]  # BREAK is the last
        rank = np.zeros(len(words) + 1, np.int64)
        rank[[self.numbers[w] for w in words]] = np.arange(1, len(words) + 1)
        run = rank[np.concatenate([*self.parts, np.zeros(longest, np.int64)])]
        inside = run > 0
        inside[len(run) - longest - ahead :] = False
        path, packs = run << BITS * (longest - 1), []
        packs.append(path[inside])
        for k in range(1, longest):
            after = np.concatenate([run[k:], np.zeros(k, np.int64)])
            inside = inside & (after > 0)
            path = path | (after << BITS * (longest - 1 - k))
            packs.append(path[inside])
        paths, counts = np.unique(np.concatenate(packs), return_counts=True)
        return words, paths, counts, len(packs[0])


def serialised(words: list[bytes], paths: np.ndarray, longest: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Paths as bytes, the words joined by 0, in pieces with their places."""
    table = pa.array([None, *words], pa.large_binary())
    sizes = np.array([0, *map(len, words)], np.int64)
    ranks = [(paths >> BITS * (longest - 1 - k)) & ((1 << BITS) - 1) for k in range(longest)]
    ends, zero, lo = np.cumsum(sum(sizes[r] + 1 for r in ranks)), pa.scalar(b"\0", pa.large_binary()), 0
    while lo < len(paths):
        room = PIECE_BYTES + (ends[lo - 1] if lo else 0)
        hi = max(lo + 1, min(lo + NODES, int(np.searchsorted(ends, room))))
        yield lo, hi, pc.binary_join_element_wise(*[table.take(pa.array(r[lo:hi])) for r in ranks], zero, null_handling="skip")
        lo = hi


def _packed(paths: pa.Array, counts: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays([paths, counts], ["path", "n"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text, and BREAK between phrases, in lists of bounded size."""
    rest = b""
    for lo in range(0, len(text), PART):
        made = (rest + text[lo : lo + PART].encode().translate(TO).replace(BREAK, b" \xff ")).split(b" ")
        rest = made.pop() if lo + PART < len(text) else b""  # it may go on in the next part
        yield list(filter(None, made))


PIECES = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("nodes", pa.int64()), ("words", pa.int64()), ("blob", pa.binary())])


def tries(docs: DataFrame, longest: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, first, last (paths), nodes, words (those of the whole shard, with its first piece), blob: the sorted pieces of all shards' tries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        held = 0

        def ended(now: str | None = None, ahead: int = 0) -> Iterator[pa.RecordBatch]:
            while shards:
                name, shard = shards.popitem()
                words, paths, counts, n = shard.trie(longest, ahead if name == now else 0)
                del shard
                for lo, hi, piece in serialised(words, paths, longest):
                    blob = _packed(piece, pa.array(counts[lo:hi]))
                    yield _rows([(name, piece[0].as_py(), piece[-1].as_py(), hi - lo, 0 if lo else n, blob)], PIECES)

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tail: list[bytes] = []
                for words in words_of(whole):
                    if held + len(words) > WORDS:
                        yield from ended(name, len(tail))
                        shards[name] = Shard()
                        shards[name].add(tail)
                        held = len(tail)
                    shards.setdefault(name, Shard()).add(words)
                    held += len(words)
                    tail = [*tail, *words][1 - longest :]
                if tail:
                    shards[name].add([BREAK])
                    held += 1
        yield from ended()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, first binary, last binary, nodes long, words long, blob binary")


def borders(pieces: DataFrame) -> list[tuple[str, bytes]]:
    """Where the second range and all later ones begin. Bounded; it decides only how work is dealt out."""
    total = pieces.agg(F.sum("nodes").alias("n"), F.count("*").alias("c")).first()
    wanted = min(max(4 * partitions(pieces.sparkSession), (total.n or 0) // RANGE_NODES), MOST_RANGES, total.c)
    some = pieces.select("lang", F.substring("first", 1, FIRST_BYTES).alias("first"))
    if total.c > FIRSTS:
        some = some.orderBy(F.xxhash64("lang", "first")).limit(FIRSTS)
    firsts = sorted((r.lang.encode(), bytes(r.first)) for r in some.collect())
    at = sorted({firsts[len(firsts) * i // wanted] for i in range(1, wanted)}) if wanted > 1 else []
    return [(name.decode(), path) for name, path in at]


def dealt(pieces: DataFrame, points: list[tuple[str, bytes]]) -> DataFrame:
    """range, lang, first, blob: pieces cut at the borders; nodes that a later border goes through are sent to its range too."""
    keys = [(name.encode(), path) for name, path in points]
    through: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for i, (name, path) in enumerate(keys):
        at = path.find(b"\0")
        while at >= 0:
            through[name, path[:at]].append(i + 1)
            at = path.find(b"\0", at + 1)
    marks = sorted(through)
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("blob", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                name = r["lang"].encode()
                lo, hi = bisect.bisect_right(keys, (name, r["first"])), bisect.bisect_right(keys, (name, r["last"]))
                shared = marks[bisect.bisect_left(marks, (name, r["first"])) : bisect.bisect_right(marks, (name, r["last"]))]
                if lo == hi:
                    out.append((lo, r["lang"], r["first"], r["blob"]))
                if lo == hi and not shared:
                    continue
                nodes = _unpacked(r["blob"])
                paths = nodes["path"].to_pylist()
                if lo < hi:
                    cuts = [0, *(bisect.bisect_left(paths, keys[k][1]) for k in range(lo, hi)), len(paths)]
                    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                        if a < b:
                            part = nodes.slice(a, b - a).combine_chunks()
                            out.append((lo + k, r["lang"], paths[a], _packed(part["path"].chunk(0), part["n"].chunk(0))))
                for mark in shared:
                    at = bisect.bisect_left(paths, mark[1])
                    if at < len(paths) and paths[at] == mark[1]:
                        one = nodes.slice(at, 1).combine_chunks()
                        blob = _packed(one["path"].chunk(0), one["n"].chunk(0))
                        out += [(k, r["lang"], mark[1], blob) for k in through[mark]]
            yield _rows(out, schema)

    return pieces.select("lang", "first", "last", "blob").mapInArrow(run, "range int, lang string, first binary, blob binary")


class Walk:
    """Merges the sorted pieces of one range and language, and walks the nodes in preorder."""

    def __init__(self, least: int, border: bytes):
        self.least, self.border = least, border
        self.tables: list[pa.Table] = []
        self.nodes, self.room = 0, HELD
        self.stack: list[tuple[bytes, int]] = []

    def add(self, first: bytes, piece: pa.Table) -> Iterator[tuple]:
        if self.nodes + len(piece) > self.room:
            yield from self.passed(first)
            self.room = max(HELD, 2 * self.nodes)
        self.tables.append(piece)
        self.nodes += len(piece)

    def passed(self, bound: bytes | None = None) -> Iterator[tuple]:
        """The nodes before `bound`, which no later piece can hold, as (path, n, left counts)."""
        if not self.tables:
            return
        merged = pa.concat_tables(self.tables).group_by("path").aggregate([("n", "sum")])
        if bound is None:
            done, self.tables, self.nodes = merged, [], 0
        else:
            early = pc.less(merged["path"], pa.scalar(bound, pa.large_binary()))
            done, later = merged.filter(early), merged.filter(pc.invert(early))
            self.tables, self.nodes = [later.rename_columns({"n_sum": "n"}).select(["path", "n"])], len(later)
        done = done.filter(pc.greater_equal(done["n_sum"], self.least)).sort_by("path")
        for path, n in zip(done["path"].to_pylist(), done["n_sum"].to_pylist(), strict=True):
            while self.stack and not path.startswith(self.stack[-1][0]):
                self.stack.pop()
            if path >= self.border:
                yield path, n, [c for _, c in self.stack]
            self.stack.append((path + b"\0", n))


def merged(parts: DataFrame, points: list[tuple[str, bytes]], least: int) -> DataFrame:
    """lang, phrase, rest, n, lefts: phrases with `least` occurrences, the phrase without its first word, and the counts of its left parts, shortest first."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("rest", pa.string()), ("n", pa.int64()), ("lefts", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, out = None, Walk(least, b""), []

        def told(nodes: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            for path, n, lefts in nodes:
                text = path.translate(BACK).decode()
                out.append((now[1], text, text.partition(" ")[2] or None, n, lefts))
                if len(out) >= 20_000:
                    yield _rows(out, schema)
                    out.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if (r["range"], r["lang"]) != now:
                    yield from told(walk.passed())
                    now = (r["range"], r["lang"])
                    start = points[now[0] - 1] if now[0] else ("", b"")
                    walk = Walk(least, start[1] if start[0] == now[1] else b"")
                yield from told(walk.add(r["first"], _unpacked(r["blob"])))
        yield from told(walk.passed())
        yield _rows(out, schema)

    rows = parts.repartition(partitions(parts.sparkSession), "range").sortWithinPartitions("range", "lang", "first")
    return rows.mapInArrow(run, "lang string, phrase string, rest string, n long, lefts array<long>")


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, cover: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to `longest` words of each language, by their weakest cut.

    Phrases inside a longer one that has `cover` % of their occurrences are left out. `longest`: 2 or 3; `least`: 1 or more."""
    if longest not in (2, 3) or least < 1:
        raise ValueError("phrases have 2 or 3 words and occur at least once")
    work = Workspace(docs.sparkSession, "collocations")
    pieces = work.keep(tries(docs, longest, lang, text), "tries")
    points = borders(pieces)
    nodes = work.keep(merged(dealt(pieces, points), points, least), "nodes")
    totals = work.keep(pieces.groupBy("lang").agg(F.sum("words").alias("words")), "totals")
    found = nodes.filter("rest IS NOT NULL")
    links = nodes.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("_r"), F.col("rest").alias("_rest"))
    for k in range(1, longest):  # suffix links: to the phrase without its first word, then on from there
        found = join_sized(found, links, ["lang", "rest"], "left").withColumn(f"r{k}", F.col("_r")).withColumn("rest", F.col("_rest")).drop("_r", "_rest")

    def cut(k: int):
        left, right = F.get("lefts", F.lit(k - 1)), F.col(f"r{k}")
        score = F.expr(f"(CAST(n AS decimal(18,0)) * CAST(n AS decimal(18,0)) * 1000000BD) div (CAST(get(lefts, {k - 1}) AS decimal(18,0)) * CAST(r{k} AS decimal(18,0)))")
        return F.when(right.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))

    found = work.keep(found.withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, longest)]))).select("lang", "phrase", F.col("n").alias("a"), "cut"), "candidates")
    if longest > 2:
        words = F.split("phrase", " ")
        inner = F.array(F.concat_ws(" ", F.slice(words, 1, 2)), F.concat_ws(" ", F.slice(words, 2, 2)))
        over = found.filter(F.size(words) == 3).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
        found = found.join(over, ["lang", "phrase"], "left").filter(F.coalesce(F.col("over") * 100 < F.col("a") * cover, F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    found = join_sized(found, totals, "lang", "inner")
    return found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("words").alias("n"), F.col("cut.score").alias("score"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
x AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(ws[1 : j], ' ') AS left_part, array_to_string(ws[j + 1 : ], ' ') AS right_part FROM c, (VALUES (1), (2)) v(j) WHERE j < k),
y AS MATERIALIZED (SELECT x.*, f.a AS l FROM x JOIN f ON f.lang = x.lang AND f.phrase = x.left_part),
cuts AS (SELECT y.lang, y.phrase, y.a, j, l, f.a AS r, CAST((CAST(1000000 AS HUGEINT) * y.a * y.a) // (CAST(l AS HUGEINT) * f.a) AS BIGINT) AS score FROM y JOIN f ON f.lang = y.lang AND f.phrase = y.right_part),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, inner_phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS inner_phrase FROM c WHERE k = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, t.n, score
FROM s JOIN t ON t.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.inner_phrase = s.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * s.a QUALIFY rank <= 2000"""
