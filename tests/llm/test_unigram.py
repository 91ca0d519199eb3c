import random

import numpy as np
import public_tokenizers
import pytest
from sparktrail.llm import unigram as ug

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return ug.unigram(PATH)


def brute(model, text):
    """Best score of a text by the plain recurrence."""
    score = dict(zip(model.vocabulary.pieces, model.vocabulary.scores.tolist()))
    s = ug.MARK + text.replace(" ", ug.MARK)
    best = [0.0] + [-np.inf] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + model.longest) + 1):
            if s[i:j] in score:
                best[j] = max(best[j], best[i] + score[s[i:j]])
        if s[i] not in score:
            best[i + 1] = max(best[i + 1], best[i] + model.low)
    return best[-1]


def total(model, text, ids):
    by_id = dict(zip(model.vocabulary.ids, model.vocabulary.scores.tolist()))
    unknown = [c for c in ug.MARK + text.replace(" ", ug.MARK) if c not in set(model.vocabulary.pieces)]
    assert sum(i in model.vocabulary.byte_ids for i in ids) == sum(len(c.encode()) for c in unknown)
    return sum(by_id.get(i, 0.0) for i in ids) + model.low * len(unknown)


def texts():
    rng = random.Random(4)
    out = ["", "Hello world", "  two  spaces ", "tab\tand\nnew\r\nlines", "naïve café 東京 😀 \x00 ́x", "a" * 5000, f"own {ug.MARK} marker{ug.MARK}{ug.MARK}", ug.MARK, " "]
    out += ["".join(rng.choice("abcdeth nio  .,é\n") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    return out


def test_best_path_and_round_trip(model):
    for text, ids in zip(texts(), model.encode(texts())):
        assert model.decode(ids) == text
        if text and ug.MARK not in text:
            assert abs(total(model, text, ids.tolist()) - brute(model, text)) < 1e-6 * max(1, len(text))


def test_trie(model):
    t = model.trie
    for k, piece in list(enumerate(model.vocabulary.pieces))[::37]:
        s = 0
        for c in piece:
            n = t.base[s] + t.code[ord(c)]
            assert t.check[n] == s
            s = n
        assert t.value[s] == k


def test_rows(spark, model):
    rows = [(i, t, "s", "clash") for i, t in enumerate(texts())] + [(None, None, None, None), (1, "Hello world", "s", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string")
    got = ug.digests(df, PATH).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    full = {r.doc_id: r for r in ug.coded(df, PATH).collect()}
    assert full[None].ids == [] and all(r.n_tokens == len(r.ids) and r.round_trip for r in full.values())
    assert ug.digests(df.limit(0), PATH).count() == 0 and ug.coded(df.limit(0), PATH).count() == 0
