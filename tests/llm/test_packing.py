import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sparktrail.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31, 32])
def test_pack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        assert (packing.unpack(packing.pack(ids, bits), bits, n) == ids).all()


@pytest.mark.parametrize("block", [64, 4096, 100])
def test_file_random_access(block):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49408, n) for n in (0, 1, 700, 3, 5000, 64, 0)]
    file = packing.PackedFile(packing.encode_file(list(range(7)), [len(d) for d in docs], np.concatenate(docs), packing.width(49408), block))
    assert file.bits == 16 and all((file.document(k) == d).all() for k, d in enumerate(docs))
    assert (file.ids(100, 4900) == np.concatenate(docs)[100:4900]).all()


def texts():
    rng = random.Random(9)
    out = [None, "", " ", "It's John's, we'll see... 12,345 éÉ ß İ ΣΣ", "a b\x1cc\x85d", "é x ́y", "<|endoftext|> <|startoftext|>", "\x00 zero", "Hello, World. HELLO,", "tab\tand\x0bmore\x0c", "東京 \U0001f600", "word " * 20_000]
    out += [" ".join("".join(rng.choice("abcdeABCéÉ.,'&%1") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return out


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_library(special):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = not special
    coder = packing.Encoder(PATH, 2, most=300, special=special)
    assert coder.apart
    for _ in range(2):
        for text, ids in zip(texts(), coder.encode([t or "" for t in texts()]), strict=True):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], text


def test_special_strings_as_the_library_loads_them():
    (ids,) = packing.Encoder(PATH, 2).encode(["see <|endoftext|> here"])
    assert ids.tolist() == [862, 49407, 763, 2]


def test_round_trip(spark):
    plain = Tokenizer.from_file(PATH)
    rows = sorted((random.Random(i).randint(0, 10**9), t, "clash") for i, t in enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = {r.doc_id: r for r in packing.round_trip(df, PATH).collect()}
    at = 0
    for d, text, _ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_files_of_bounded_size(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(60, "x " * 30_000)]
    folder = f"file://{tmp_path}/files"
    made = packing.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, folder, end_id=2, file_ids=1000)
    files = sorted(made.collect(), key=lambda r: (r.part, r.k))
    assert len(files) > 8 and max(r.k for r in files) > 0 and sum(r.docs for r in files) == 61
    assert all(r.ids < 1000 + 30_001 for r in files) and sum(r.ids for r in files) == sum(len(t.split()) + 1 for _, t in rows)
    held = [packing.PackedFile(open(f"{tmp_path}/files/{r.file}", "rb")) for r in files]
    assert [len(f.document(k)) for f in held for k in range(len(f.doc_ids))] == [len(t.split()) + 1 for _, t in rows]
    at, given = 0, []
    for r in files:
        given.append((r.file, at))
        at += r.ids
    back = {r.doc_id: (r.start, r.n_tokens) for r in packing.read(spark, folder, given, read_ids=64).collect()}
    sizes = [len(t.split()) + 1 for _, t in rows]
    assert back == {i: (sum(sizes[:i]), n) for i, n in enumerate(sizes)}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "no id"), (3, "b"), (3, "b"), (3, None)]
    got = packing.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 4 and sorted(r.start for r in got)[0] == 0 and {r.doc_id for r in got if r.start == 0} == {None}
    assert packing.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
