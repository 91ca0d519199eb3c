import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from sparktrail.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_pairs.load(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.encoder(PATH, public_tokenizers.PATTERN)


def texts():
    rng = random.Random(12)
    out = ["", " ", "Hello world", "  two  spaces \n\n x", "it's we'll I'D", "naïve café 東京 😀 \x00 ́x‍", "<|endoftext|>", "a" * 3000, " " * 700 + "b", "=" * 333, "1234567" * 40]
    out += ["".join(rng.choice("abcdethnio  .,é\n'東") for _ in range(rng.randint(1, 200))) for _ in range(120)]
    out += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(60, 900))) for _ in range(25)]  # long words
    out += ["".join(rng.choice(["in", "ing", "the", "ation", "er", "Un"]) for _ in range(rng.randint(20, 300))) for _ in range(25)]
    return out


def wanted(library, text):
    ids = library.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_like_the_library(coder, library):
    rows = texts()
    assert list(coder.digests(rows)) == [wanted(library, t) for t in rows]


def test_long_words_step_by_step_and_at_once(library):
    """The same words one pair a step, and all least pairs of their neighbourhoods a step."""
    rows = [t for t in texts() if len(t) > 20]
    slow, fast = byte_pairs.Encoder(RANKS, public_tokenizers.PATTERN, short=4000), byte_pairs.Encoder(RANKS, public_tokenizers.PATTERN, short=3)
    want = [wanted(library, t) for t in rows]
    assert list(fast.digests(rows)) == want and [w for t, w in zip(rows, want) if len(t) < 400] == list(slow.digests([t for t in rows if len(t) < 400]))


def test_every_code_point(coder, library):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}1{c} " for c in points[lo : lo + 3000]) for lo in range(0, len(points), 3000)]
    bad = [k for k, (a, t) in enumerate(zip(coder.digests(rows), rows)) if a != wanted(library, t)]
    assert bad == []


def test_very_long_texts_and_words(coder, library, monkeypatch):
    rng = random.Random(13)
    rows = ["some words here " * 100_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "short"]
    assert list(coder.digests(rows)) == [wanted(library, t) for t in rows]
    monkeypatch.setattr(byte_pairs, "PART", 100)
    monkeypatch.setattr(byte_pairs, "GATHERED", 7)
    monkeypatch.setattr(byte_pairs, "KEPT", 30)
    few = [t for t in texts() if len(t) < 300]
    assert list(coder.digests(few)) == [wanted(library, t) for t in few]


def test_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(7, "twice"), (7, "twice"), (None, "no id"), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    want = sorted(((i, *wanted(library, t or "")) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in byte_pairs.digests(df, PATH).collect()), key=repr) == want
    ids = byte_pairs.encoded(df, PATH)
    assert sorted(((r.doc_id, r.ids) for r in ids.collect()), key=repr) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in byte_pairs.decoded(ids, PATH).collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert byte_pairs.digests(df.limit(0), PATH).collect() == []


def test_vocabulary_without_all_bytes(tmp_path):
    path = tmp_path / "few"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="lacks"):
        byte_pairs.load(str(path))
