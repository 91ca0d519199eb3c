"""SentencePiece-style unigram encoding and decoding.

White space is marked: a text gets a marker in front, and each of its spaces becomes a marker. The
segmentation of greatest total log score is found by the Viterbi algorithm over a double-array trie
of the pieces. A character that is no piece by itself can be passed at UNKNOWN below the least
score and is written as its UTF-8 bytes, one byte piece each; so is the marker character itself when
a text holds it. Decoding joins pieces and bytes, turns markers back and drops the first one; it
restores every text exactly.

No piece continues from other characters into a marker or passes a character that no piece holds, so
the best path breaks there. Words between such breaks are solved once and kept in a bounded memo;
new ones are solved together, as one array program over all of them.

The vocabulary is a public SentencePiece file. If it is a unigram model its own log scores are used;
a merge-order (BPE) vocabulary has no log scores, so a piece at rank r gets -ln(r + 1) - ln(H), Zipf's
law over its n pieces with H the n-th harmonic number.

Defined cases: null or empty text has no tokens; repeated rows get the same answer each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK, UNKNOWN = "▁", 10.0
#: Characters of all the words that the memo holds; where white space is rare a word is a line.
LETTERS = 8_000_000


@dataclass
class Vocabulary:
    pieces: list[str]
    ids: list[int]
    scores: np.ndarray
    byte_ids: list[int]
    size: int


def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size, pieces, ids, byte_ids = model.get_piece_size(), [], [], [-1] * 256
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append(piece)
            ids.append(i)
    own = np.array([model.get_score(i) for i in ids])
    merges = len(own) > 1 and np.array_equal(own, np.round(own)) and (np.diff(own) <= 0).all()
    n = len(ids)
    zipf = -np.log(np.arange(n) + 1.0) - np.log((1.0 / (np.arange(n) + 1.0)).sum())
    return Vocabulary(pieces, ids, zipf if merges else own, byte_ids, size)


class DoubleArray:
    """base, check: the child of node s by code c is t = base[s] + c if check[t] == s. value: piece index or -1."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        tree: list[tuple[dict[int, int], int]] = [({}, -1)]
        for k, piece in enumerate(pieces):
            at = 0
            for c in self.code[[ord(c) for c in piece]].tolist():
                if c not in tree[at][0]:
                    tree[at][0][c] = len(tree)
                    tree.append(({}, -1))
                at = tree[at][0][c]
            tree[at] = (tree[at][0], k)
        room = 2 * len(tree) + 2 * self.width
        base, check, value = [0] * room, [-1] * room, [-1] * room
        taken = bytearray(room)
        taken[0] = 1
        place, free, todo = {0: 0}, 1, [0]
        for node in todo:
            children, at = tree[node][0], place[node]
            value[at] = tree[node][1]
            if not children:
                continue
            codes = sorted(children)
            while taken[free]:
                free += 1
            b, tries = max(1, free - codes[0]), 0
            while any(taken[b + c] for c in codes):
                b, tries = b + 1, tries + 1
                if b + self.width + 1 >= len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
            if tries > 200:
                free += 1  # the beginning is nearly full
            base[at] = b
            for c in codes:
                taken[b + c] = 1
                check[b + c] = at
                place[children[c]] = b + c
                todo.append(children[c])
        self.base, self.check, self.value = (np.array(x + [v] * self.width, dtype=np.int32) for x, v in ((base, 0), (check, -1), (value, -1)))


class Unigram:
    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        v = self.vocabulary = vocabulary
        if -1 in v.byte_ids:
            raise ValueError("the vocabulary lacks byte pieces")
        if any(MARK in p.lstrip(MARK) for p in v.pieces):
            raise ValueError("a piece continues into a marker")
        self.trie = DoubleArray(v.pieces)
        self.longest = max(map(len, v.pieces))
        self.low = float(v.scores.min()) - UNKNOWN
        self.ids = np.array(v.ids, dtype=np.uint32)
        self.memo: dict[str, bytes] = {}
        self.held = 0
        self.most = most
        self.words = re.compile(f"{MARK}+[^{MARK}\n\r\t]*|[\n\r\t]|[^{MARK}\n\r\t]+" if not any(c in p for p in v.pieces for c in "\n\r\t") else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.table = [b""] * v.size
        for p, i in zip(v.pieces, v.ids, strict=True):
            self.table[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(v.byte_ids):
            self.table[i] = bytes([b])

    def solve(self, words: list[str]) -> list[list[int]]:
        """Piece indexes of the best path of each word, -1 for a character written as bytes."""
        count, long = len(words), max(map(len, words))
        sizes = np.array([len(w) for w in words])
        codes = np.zeros((count, long + 1), dtype=np.int32)
        flat = self.trie.code[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        codes[np.repeat(np.arange(count), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        best = np.full((count, long + 1), -np.inf)
        best[:, 0] = 0.0
        came, piece = np.zeros((count, long + 1), dtype=np.int32), np.full((count, long + 1), -1, dtype=np.int32)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.vocabulary.scores
        for i in range(long):
            rows = np.flatnonzero(sizes > i)
            state, single = np.zeros(len(rows), dtype=np.int32), np.zeros(count, dtype=bool)
            every = rows
            for k in range(1, min(self.longest, long - i) + 1):
                c = codes[rows, i + k - 1]
                to = base[state] + c
                live = (check[to] == state) & (c > 0)
                rows, state = rows[live], to[live]
                if not len(rows):
                    break
                v = value[state]
                ends = v >= 0
                at, v = rows[ends], v[ends]
                if k == 1:
                    single[at] = True
                total = best[at, i] + scores[v]
                better = total > best[at, i + k]
                at = at[better]
                best[at, i + k], came[at, i + k], piece[at, i + k] = total[better], i, v[better]
            alone = every[~single[every]]
            total = best[alone, i] + self.low
            better = total > best[alone, i + 1]
            alone = alone[better]
            best[alone, i + 1], came[alone, i + 1], piece[alone, i + 1] = total[better], i, -1
        ends, steps, lines = sizes.copy(), [], np.arange(count)
        while (going := ends > 0).any():
            steps.append(np.where(going, piece[lines, ends], -2))
            ends = np.where(going, came[lines, ends], 0)
        return [[p for p in reversed(row) if p != -2] for row in np.array(steps).T.tolist()]

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.memo]
        size = sum(map(len, new))
        if len(self.memo) + len(new) > self.most or self.held + size > LETTERS:
            self.memo.clear()
            self.held, new = 0, list(words)
            size = sum(map(len, new))
        self.held += size
        new.sort(key=len)  # words of about one length together, so little is padding
        lo = 0
        while lo < len(new):
            hi = lo
            while hi < len(new) and (hi == lo or (hi - lo + 1) * (len(new[hi]) + 1) <= 400_000):
                hi += 1
            part = new[lo:hi]
            for w, path in zip(part, self.solve(part), strict=True):
                self.memo[w] = self.written(w, path)
            lo = hi

    def written(self, word: str, path: list[int]) -> bytes:
        if -1 not in path:
            return self.ids[path].tobytes()
        out, at = [], 0
        for p in path:
            if p >= 0:
                out.append(self.vocabulary.ids[p])
                at += len(self.vocabulary.pieces[p])
            else:
                out += [self.vocabulary.byte_ids[b] for b in word[at].encode()]
                at += 1
        return np.array(out, dtype=np.uint32).tobytes()

    def split(self, text: str) -> list[str]:
        if MARK in text:  # its own markers are set apart and written as bytes
            parts = text.split(MARK)
            out = self.words.findall(MARK + parts[0].replace(" ", MARK))
            for p in parts[1:]:
                out += ["", *self.words.findall(p.replace(" ", MARK))]
            return out
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self.split(t) for t in texts]
        self.memo.pop("", None)
        self.learn(set().union(*split) - {""})
        self.memo[""] = np.array([self.vocabulary.byte_ids[b] for b in MARK.encode()], dtype=np.uint32).tobytes()
        for words in split:
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, words)), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """One for each Python worker, which serves many tasks."""
    return Unigram(load(path))


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_chars, ids, n_tokens, round_trip: the ids, and whether decoding them gives the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = list(model.encode(texts))
                good = [model.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                sizes = [len(i) for i in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32()))
                columns = [part.column("doc_id"), part.column("source"), pa.array([len(t) for t in texts], pa.int64()), lists, pa.array(sizes, pa.int64()), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_chars", "ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_chars long, ids array<int>, n_tokens long, round_trip boolean")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 500):
                texts = [t or "" for t in batch.column("text").slice(lo, 500).to_pylist()]
                out += [(len(t), len(i), zlib.crc32(i.astype("<u4").tobytes()), model.decode(i) == t) for i, t in zip(model.encode(texts), texts, strict=True)]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_chars", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean")
