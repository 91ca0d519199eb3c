"""Byte-level BPE by recursive queries: each task holds a DuckDB connection with the merge table and encodes the words it meets.

A text's words are the matches of the pattern, and each distinct word is encoded once. Its bytes are rows (word, position,
token); a step joins each row and its follower with the merge table and contracts the pair of least rank, the leftmost among
equals, until no pair of a word is in the table. A word that is a token itself is that token. Documents are put together by
ordered aggregation over their words, and decoded by a join of the ids with the vocabulary and ordered aggregation of bytes.

Words of more than SHORT bytes take one contraction a neighbourhood and step instead of one a word and step. No token that
consists of the word's bytes is longer than some `reach`. A pair that is least among all pairs within `reach` bytes, the
leftmost of equals, comes before any merge that could touch it: pairs between untouched tokens keep their rank, so a merge from
outside can only get nearer by one token growing, and that ends before `reach`. So all such pairs are contracted at once, with
the same result; the number of steps depends on `reach`, not on the length of the word.

Defined cases: a null or empty text has no tokens, and its digests are those of no bytes; equal rows give equal rows; texts
and words of any length are encoded whole, in parts of bounded size; null ids pass on; an empty table gives an empty result;
other columns are ignored. A vocabulary that lacks a single byte is refused.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

#: Bytes of a word up to which one pair a step is contracted; words and bytes that a task keeps; words put together at once.
SHORT, KEPT, KEPT_BYTES, GATHERED = 64, 1_000_000, 32 << 20, 1 << 19
#: Characters of a text whose words are found at once.
PART = 1 << 20

#: One pair a word and step. The best one is packed: its rank, its place and the next token's place (below 2^16).
STEPS = """
CREATE TEMP TABLE ended AS
WITH RECURSIVE t(w, pos, tok, step) AS (
 SELECT w, pos, tok, 0 FROM begun
 UNION ALL
 (WITH pairs AS (SELECT w, pos, tok, lead(tok) OVER x AS then_tok, lead(pos) OVER x AS then_pos FROM t WINDOW x AS (ORDER BY w, pos)),
  best AS (SELECT w, min((CAST(m.id AS BIGINT) << 32) | (p.pos << 16) | p.then_pos) AS b FROM pairs p JOIN merges m ON p.tok = m.l AND p.then_tok = m.r WHERE p.then_pos > p.pos GROUP BY w)
  SELECT t.w, t.pos, CASE WHEN t.pos = (b >> 16) & 65535 THEN CAST(b >> 32 AS INT) ELSE t.tok END, t.step + 1 FROM t JOIN best USING (w) WHERE t.pos <> b & 65535)
)
SELECT w, pos, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step)"""

#: The state is keyed by position; a token that was merged into the one before it becomes null.
LONG_STEPS = """
CREATE TEMP TABLE ended AS
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
 SELECT w, pos, tok FROM begun
 UNION
 (WITH pairs AS (SELECT w, pos, tok, lead(tok) OVER x AS then_tok, lead(pos) OVER x AS then_pos FROM recurring.t WHERE tok IS NOT NULL AND (SELECT count(*) FROM t) > 0 WINDOW x AS (PARTITION BY w ORDER BY pos)),
  ranked AS (SELECT w, pos, then_pos, m.id FROM pairs p LEFT JOIN merges m ON p.tok = m.l AND p.then_tok = m.r),
  least AS (SELECT w, pos, then_pos, id, min(id) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING) AS before, min(id) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AS after FROM ranked),
  now AS (SELECT w, pos, then_pos, id FROM least WHERE id IS NOT NULL AND (before IS NULL OR id < before) AND (after IS NULL OR id <= after))
  SELECT w, pos, id FROM now UNION ALL SELECT w, then_pos, NULL FROM now)
)
SELECT w, pos, tok FROM t WHERE tok IS NOT NULL"""

KEEP = """
INSERT INTO words
SELECT w, count(*), string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos), string_agg(v.hex, '' ORDER BY pos) FROM ended JOIN vocabulary v ON v.id = tok GROUP BY w"""

#: The connection has one thread, so aggregates take their input in its order; one sort serves both.
GATHER = "SELECT doc, CAST(sum(n) AS BIGINT), string_agg(ids, ' '), unhex(string_agg(hex, '')) FROM (SELECT doc, n, ids, hex FROM met JOIN words USING (w) ORDER BY i) GROUP BY doc"


def load(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    return ranks


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, short: int = SHORT):
        self.ranks, self.words, self.short = ranks, regex.compile(pattern), short
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        parts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, id_ = (pa.array(c, pa.int32()) for c in zip(*parts, strict=True)) if parts else (pa.array([], pa.int32()),) * 3
        self.create("merges", pa.table({"l": left, "r": right, "id": id_}))
        self.create("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}))
        self.clear()

    def create(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def clear(self) -> None:
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        self.known, self.held = 0, 0
        self.db.execute("CREATE OR REPLACE TABLE words (w INT, n BIGINT, ids VARCHAR, hex VARCHAR)")

    def reach(self, word: bytes) -> int:
        """Length of the longest token of the word's bytes alone."""
        own = set(word)
        return max(len(t) for t in self.ranks if own.issuperset(t))

    def solve(self, words: list[tuple[int, bytes]], statement: str) -> None:
        """Adds the tokens of the words, given with their numbers."""
        sizes = np.array([len(b) for _, b in words])
        flat = np.frombuffer(b"".join(b for _, b in words), np.uint8)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = pa.array(np.arange(len(flat)) - starts, pa.int32())
        self.create("begun", pa.table({"w": pa.array(np.repeat([w for w, _ in words], sizes), pa.int32()), "pos": at, "tok": pa.array(self.bytes[flat], pa.int32())}))
        self.done(statement)

    def done(self, statement: str) -> None:
        self.db.execute(statement)
        self.db.execute(KEEP)
        self.db.execute("DROP TABLE ended")

    def learn(self) -> None:
        """Encodes the words that were numbered since the last call."""
        new = [(w, word.encode()) for word, w in itertools.islice(self.numbers.items(), self.known, None)]
        self.known = len(self.numbers)
        self.held += sum(len(b) for _, b in new)
        whole = [(w, self.ranks[b]) for w, b in new if b in self.ranks]
        if whole:
            self.create("met_whole", pa.table({"w": pa.array([w for w, _ in whole], pa.int32()), "tok": pa.array([t for _, t in whole], pa.int32())}))
            self.done("CREATE TEMP TABLE ended AS SELECT w, 0 AS pos, tok FROM met_whole")
        rest = [(w, b) for w, b in new if b not in self.ranks]
        brief = [(w, b) for w, b in rest if len(b) <= self.short]
        for lo in range(0, len(brief), 50_000):
            self.solve(brief[lo : lo + 50_000], STEPS)
        for w, b in rest:
            if len(b) > self.short:
                self.solve([(w, b)], LONG_STEPS.format(reach=self.reach(b)))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, in lists of bounded size."""
        if len(text) <= PART:
            yield self.words.findall(text)
            return
        found = (m.group() for m in self.words.finditer(text))
        while part := list(itertools.islice(found, GATHERED)):
            yield part

    def gather(self, docs: list[int], lists: list[list[str]]) -> dict[int, tuple[int, str, bytes]]:
        """For each document: how many tokens, the ids, and the decoded bytes of its words."""
        if len(self.numbers) > KEPT or self.held > KEPT_BYTES:
            self.clear()
        sizes = [len(x) for x in lists]
        met = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(lists)), np.int32, sum(sizes))
        self.learn()
        self.db.register("met", pa.table({"doc": np.repeat(docs, sizes), "i": np.arange(len(met)), "w": met}))
        out = {doc: (n, ids, text) for doc, n, ids, text in self.db.execute(GATHER).fetchall()}
        self.db.unregister("met")
        return out

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of tokens, and the SHA-256 of its ids, and of the bytes they decode to."""
        open_: dict[int, list] = {}
        docs: list[int] = []
        lists: list[list[str]] = []

        def flush() -> None:
            for doc, (n, ids, text) in self.gather(docs, lists).items() if docs else ():
                state = open_[doc]
                state[1].update(b" " * (state[0] > 0) + ids.encode())
                state[2].update(text)
                state[0] += n
            docs.clear()
            lists.clear()

        waiting = 0
        for k, text in enumerate(texts):
            open_[k] = [0, hashlib.sha256(), hashlib.sha256()]
            for part in self.parts(text or ""):
                if docs and docs[-1] == k or waiting + len(part) > GATHERED:
                    flush()
                    waiting = 0
                docs.append(k)
                lists.append(part)
                waiting += len(part)
        flush()
        for n, ids, text in open_.values():
            yield n, ids.hexdigest(), text.hexdigest()


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(load(path), pattern)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            rows = list(coder.digests(batch.column(1).to_pylist()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            ids = []
            for t in batch.column(1).to_pylist():
                parts = [coder.gather([0], [p])[0][1] for p in coder.parts(t or "") if p]
                ids.append([int(i) for p in parts for i in p.split()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text: the ids joined with the vocabulary, their bytes put together in order. Bytes that aren't UTF-8 become U+FFFD; an unknown id is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = encoder(path, public_tokenizers.PATTERN).db
        for batch in batches:
            lists = batch.column(1)
            db.register("coded", pa.table({"doc": pa.array(range(len(lists)), pa.int64()), "ids": lists}))
            each = "SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM coded"
            made = dict(db.execute(f"SELECT doc, unhex(string_agg(CASE WHEN hex IS NULL THEN error('unknown id ' || e.id) ELSE hex END, '' ORDER BY i)) FROM ({each}) e LEFT JOIN vocabulary v USING (id) GROUP BY doc").fetchall())
            db.unregister("coded")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made.get(k, b"").decode("utf-8", "replace") for k in range(len(lists))], pa.string())], ["doc_id", "text"])

    rows = tokens.select(tokens[key].alias("doc_id"), tokens[ids].alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
