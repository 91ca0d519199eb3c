"""Token ids in fixed-width bit packing, written as files and read back.

File: magic `BPK2`, the blocks, then the documents' ids, the start of each document among the file's
ids, the byte offset of each block, and at the very end the little-endian 64-bit words (bits an id,
ids a block, documents, ids, blocks). A block is 64 * k ids packed into bits * k 64-bit words, the
last one padded with zeros. Width is the fewest bits that hold the vocabulary. Any id range is read
from the blocks that overlap it, and unpacked by shifts of whole columns.

Documents are range-partitioned by doc_id on split points and sorted inside. A range is written
block by block, to a new file after FILE_IDS ids, so a task holds a block and the index of one file;
it is read back a stretch of blocks at a time. The driver holds one row a file. Files are moved to
their final name when complete, so a task that runs twice writes the same bytes to the same place.

Strings of special tokens in a text get those tokens' ids, as the library does when it is loaded from
its file; with special=False they are ordinary text.

Defined cases: a null text is an empty one (only the end id); null ids come first; equal ids in
order of their text's ids; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions, slices, splits

MAGIC, BLOCK = b"BPK2", 4096
#: Ids after which a new file begins; ids that a reader unpacks at a time; bytes of text that are encoded at a time.
FILE_IDS, READ_IDS, TEXT_BYTES = 1 << 25, 1 << 20, 1 << 23
NULL_ID = np.iinfo(np.int64).min


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids to `bits` words, ids padded with zeros to whole 64s."""
    n = -(-len(ids) // 64)
    padded = np.zeros(n * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    columns, out = padded.reshape(n, 64), np.zeros((n, bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= columns[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= columns[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), 64), dtype=np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:count]


class Writer:
    """Packs documents to a file-like object, block by block."""

    def __init__(self, file, bits: int, block: int = BLOCK):
        self.file, self.bits, self.block = file, bits, block
        self.doc_ids, self.starts, self.offsets = [], [0], [0]
        self.rest, self.held = [], 0
        file.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block:
            self.flush(self.held // self.block * self.block)

    def flush(self, count: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, dtype=np.uint32)
        for i in range(0, count, self.block):
            raw = pack(ids[i : min(i + self.block, count)], self.bits)
            self.file.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.rest, self.held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self.flush(self.held)
        tail = np.array([self.bits, self.block, len(self.doc_ids), self.starts[-1], len(self.offsets) - 1], dtype="<i8")
        self.file.write(b"".join(np.array(x, dtype="<i8").tobytes() for x in (self.doc_ids, self.starts, self.offsets)) + tail.tobytes())


def encode_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    import io

    out, at = io.BytesIO(), 0
    writer = Writer(out, bits, block)
    for d, n in zip(doc_ids, lengths, strict=True):
        writer.add(d, ids[at : at + n])
        at += n
    writer.close()
    return out.getvalue()


class PackedFile:
    """Random access to a file's documents; `data` is bytes, a memory map, or a file that can seek."""

    def __init__(self, data):
        if hasattr(data, "seek"):
            size = data.seek(0, 2) if not hasattr(data, "size") else data.size()

            def read(a: int, b: int) -> bytes:
                data.seek(a)
                return data.read(b - a)
        else:
            view = memoryview(data)
            size = len(view)

            def read(a: int, b: int) -> bytes:
                return view[a:b]

        self.read = read
        if size < 44 or bytes(read(0, 4)) != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.block, n, self.n_ids, blocks = (int(x) for x in np.frombuffer(read(size - 40, size), dtype="<i8"))
        counts = (n, n + 1, blocks + 1)
        index, at, parts = np.frombuffer(read(size - 40 - 8 * sum(counts), size - 40), dtype="<i8"), 0, []
        for count in counts:
            parts.append(index[at : at + count])
            at += count
        self.doc_ids, self.starts, self.offsets = parts

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        a, b = start // self.block, -(-end // self.block)
        first = a * self.block
        body = memoryview(self.read(4 + int(self.offsets[a]), 4 + int(self.offsets[b])))
        if self.block % 64 == 0:
            whole = unpack(body, self.bits, min(b * self.block, self.n_ids) - first)
        else:
            cuts = (self.offsets[a : b + 1] - self.offsets[a]).tolist()
            whole = np.concatenate([unpack(body[cuts[k - a] : cuts[k - a + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b)])
        return whole[start - first : end - first]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """The tokenizers library behind a bounded memo of words.

    This kind of pre-tokenizer drops white space and never joins across it, so a text's ids are those
    of its words in turn. A batch's words are told apart by Arrow; the library encodes each new distinct
    word once, many in one call, and Arrow puts the words' ids back in place. Words of plain letters,
    with a full stop or comma behind at most, are one or two pre-tokens, whatever their case: they go to
    the library's model without its normalizer and pattern. Texts of which this isn't certain go to the
    library whole: those with odd white space, characters that compose across a word's edge, or strings
    of added tokens. `words_apart` checks that the tokenizer is of this kind."""

    def __init__(self, path: str, end_id: int | None, most: int = 500_000, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.tail = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
        known = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in known["added_tokens"]] if special else [x["content"] for x in known["added_tokens"] if not x["special"]]
        self.words, self.ids, self.most, self.apart = pa.array([], pa.string()), pa.array([], pa.binary()), most, self.words_apart(known)
        if self.apart:
            bare = known | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, known["pre_tokenizer"]["pretokenizers"][1]]}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.bare.encode_special_tokens = not special
            self.marks = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            self.apart = len(self.marks) == 1 and self.bare.encode(MARK, add_special_tokens=False).ids == self.marks
            self.stops = pa.array([np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in (".", ",", "")], pa.binary())

    @staticmethod
    def words_apart(known: dict) -> bool:
        steps = [x["type"] for x in (known["normalizer"] or {}).get("normalizers", [])]
        pre = (known["pre_tokenizer"] or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and "\\s" in pre[0]["pattern"]["Regex"]

    def many(self, tokenizer, words: pa.Array) -> pa.Array:
        """Ids of words, as bytes; encoded as one text, parted by a character that no word has."""
        values, offsets = [], [0]
        for i in range(0, len(words), 5000):
            part = words.slice(i, 5000)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), f" {MARK} ")[0].as_py()
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            marks = ids == self.marks[0]
            at = np.flatnonzero(marks)
            values.append(ids[~marks])
            offsets += (offsets[-1] + at - np.arange(len(at))).tolist() + [offsets[-1] + len(ids) - len(at)]
        starts = 4 * np.array(offsets, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(starts), pa.py_buffer(np.concatenate(values) if values else b"")])

    def solve(self, words: pa.Array) -> pa.Array:
        """Ids of new distinct words."""
        simple = pc.match_substring_regex(words, LETTERS)
        odd = self.many(self.tokenizer, words.filter(pc.invert(simple)))
        plain = words.filter(simple)
        cores = pc.utf8_lower(pc.utf8_rtrim(plain, characters=".,")).dictionary_encode()
        body = self.many(self.bare, cores.dictionary).take(cores.indices)
        last = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(plain, -1), value_set=pa.array([".", ","])), 2)
        body = pc.binary_join_element_wise(body, self.stops.take(last), b"")
        flags = simple.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), dtype=np.int64)
        place[~flags], place[flags] = np.arange(len(odd)), len(odd) + np.arange(len(body))
        return pa.concat_arrays([odd, body]).take(pa.array(place))

    def lookup(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        known, ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self.solve(new)])
        place = pc.fill_null(at, 0).to_numpy().copy()
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        found = ids.take(pa.array(place))
        # beyond its bound the memo goes on with the words of this batch
        self.words, self.ids = (known, ids) if len(known) <= self.most else (words, found)
        return found

    def together(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose words are apart."""
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if not len(coded):
            return [self.tail] * len(texts)
        ids = self.lookup(coded.dictionary)
        sizes = pc.binary_length(ids).to_numpy().astype(np.int64)
        every = ids.take(coded.indices)
        body = memoryview(every.buffers()[2] or b"")
        ends = np.zeros(len(coded) + 1, dtype=np.int64)
        np.cumsum(sizes[coded.indices.to_numpy()], out=ends[1:])
        cuts = ends[offsets - offsets[0]].tolist()
        return [b"".join((body[a:b], self.tail)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def raw(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; null is an empty text."""
        texts = pc.fill_null(texts, "")
        for lo, hi in slices(texts, TEXT_BYTES):
            part = texts.slice(lo, hi - lo)
            whole = pc.match_substring_regex(part, ODD) if self.apart else pa.array([True] * len(part))
            for content in self.added if self.apart else ():
                whole = pc.or_(whole, pc.match_substring(part, content))
            apart = iter(self.together(part.filter(pc.invert(whole))))
            for k, odd in enumerate(whole.to_pylist()):
                yield np.array(self.tokenizer.encode(part[k].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes() + self.tail if odd else next(apart)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.frombuffer(x, dtype="<u4") for x in self.raw(pa.array(texts, pa.string())))


#: Parts words in one call to the library; texts that hold it go to the library whole.
MARK = "\x00"
#: Letters whose lower case is one letter, and composed already; one stop behind.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"
#: White space that only some of the parties know (words are parted at the ASCII kind), and characters that compose with the one before them.
ODD = "[\\x00\\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\u0130\u0300-\u036f\u1100-\u11ff]"


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None, special: bool = True) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path, end_id, special=special)


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, path: str, folder: str, vocabulary: int | None = None, end_id: int | None = None, special: bool = True, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files of each doc_id range under `folder`; returns part, k, file, docs, ids, one row a file, in doc_id order by part and k."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    points = np.array(splits(docs, "doc_id", partitions(spark)), dtype=np.int64)
    vocabulary = vocabulary or Tokenizer.from_file(path).get_vocab_size()
    bits = width(max(vocabulary, (end_id or 0) + 1))
    kind = "<u2" if bits <= 16 else "<u4"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, end_id, special)
        for batch in batches:
            ids = batch.column("doc_id")
            part = np.where(ids.is_null(), 0, np.searchsorted(points, pc.fill_null(ids, 0).to_numpy(), side="right"))
            out, lo, held = [], 0, 0

            def made(lo: int, hi: int, out: list, part=part, ids=ids) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(part[lo:hi], pa.int64()), ids.slice(lo, hi - lo), pa.array(out, pa.binary())], ["part", "doc_id", "ids"])

            for raw in coder.raw(batch.column("text")):
                out.append(np.frombuffer(raw, dtype="<u4").astype(kind).tobytes())
                held += len(out[-1])
                if held > TEXT_BYTES:
                    yield made(lo, lo + len(out), out)
                    lo, out, held = lo + len(out), [], 0
            yield made(lo, lo + len(out), out)

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, root = file_system(folder)
        part, k, writer, temp, made = None, 0, None, None, []

        def finish() -> None:
            writer.close()
            writer.file.close()
            name = f"{part:06d}-{k:04d}.bpk"
            store_fs.move(temp, f"{root}/{name}")
            made.append((part, k, name, len(writer.doc_ids), writer.starts[-1]))

        for batch in batches:
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if writer and (p != part or writer.starts[-1] >= file_ids):
                    finish()
                    k, writer = k + 1 if p == part else 0, None
                if not writer:
                    part, temp = p, f"{root}/.{p:06d}-{uuid.uuid4().hex}"
                    writer = Writer(store_fs.open_output_stream(temp), bits)
                writer.add(NULL_ID if d is None else d, np.frombuffer(x.as_buffer(), dtype=kind))
        if writer:
            finish()
        names, types = ["part", "k", "file", "docs", "ids"], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(types)], names)

    file_system(folder)[0].create_dir(file_system(folder)[1])
    rows = docs.select("doc_id", "text").mapInArrow(encode, "part long, doc_id long, ids binary")
    rows = rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "ids")
    return rows.mapInArrow(store, "part long, k long, file string, docs long, ids long")


def read(spark, folder: str, files: list[tuple[str, int]], read_ids: int = READ_IDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files given with the number of ids before each; `read_ids` ids or one document at a time."""

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_fs, root = file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store_fs.open_input_file(f"{root}/{name}") as f:
                    packed = PackedFile(f)
                    s, lo = packed.starts, 0
                    while lo < len(packed.doc_ids):
                        hi = max(lo + 1, int(np.searchsorted(s, s[lo] + read_ids, side="right")) - 1)
                        hi = min(hi, len(packed.doc_ids))
                        ids = memoryview(packed.ids(int(s[lo]), int(s[hi])).astype("<u4").view(np.uint8))
                        cuts = (4 * (s[lo : hi + 1] - s[lo])).tolist()
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        own = packed.doc_ids[lo:hi]
                        yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(s[lo:hi] + base), pa.array(np.diff(s[lo : hi + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        lo = hi

    df = spark.createDataFrame(files, "file string, base long")
    return df.repartition(max(1, min(len(files), partitions(spark)))).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, special: bool = True) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{Workspace(spark, 'packed').path}/files"
    files, base = [], 0
    for r in sorted(write(docs.select("doc_id", "text"), path, folder, end_id=end_id, special=special).collect(), key=lambda r: (r.part, r.k)):
        files.append((r.file, base))
        base += r.ids
    return read(spark, folder, files)
