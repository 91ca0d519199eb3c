"""Each stage of the pipeline on its own input, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from sparktrail.llm import secrets as sc

from test_jaccard_join import brute
from test_mixing import wanted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t long, kept string, h string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_t", "kept", "h"]
SPACE = r"[\x20\x09-\x0D]+"


def rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    menu, out = "Home and News 2024", []
    for i in range(120):
        lines = [" ".join(word() for _ in range(20)) for _ in range(rng.randint(3, 8))]
        if i % 4 == 0:
            lines.insert(1, menu.replace("2024", str(2000 + i)))
        if i % 7 == 0:
            lines.append("api_key = " + "".join(rng.choice("ABCDEFGHIJ0123456789xyz") for _ in range(24)))
        out.append("\n".join(lines))
    for i in range(0, 30, 3):  # copies and near copies
        out += [out[i]] * (1 + i % 2) + [out[i].replace(" ", " x ", 1)]
    out += [None, "", "too short", "again and again " * 60, "long " + " ".join(word() for _ in range(30_000))]
    made = [(5 * i + 2, t, "en", rng.choice(["a", "b", "hot", "hot", "hot"]), len(t or ""), i, "clash", "clash") for i, t in enumerate(out)]
    made += [made[3], made[3], (None, out[8], None, None, 1, 1, None, None), (9001, out[9] + " tail", "en", None, 5, 1, "x", "x")]
    rng.shuffle(made)
    return made


def lines_of(text):
    plain = [re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x)).lower().strip(" ") for x in (text or "").split("\n")]
    return list(zip((text or "").split("\n"), plain, strict=True))


def base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def cleaned(made):
    texts, held = defaultdict(set), defaultdict(set)
    for r in made:
        texts[r[3]].add(r[1] or "")
    for host, group in texts.items():
        for t in group:
            for _, plain in lines_of(t):
                if plain:
                    held[host, plain].add(t)
    out = []
    for r in made:
        gone = {p for _, p in lines_of(r[1]) if p and len(held[r[3], p]) > max(2, 0.05 * len(texts[r[3]]))}
        lost, every = (sum(len(p) for _, p in lines_of(r[1]) if p and (not only or p in gone)) for only in (True, False))
        if not base_failed(r[1]) and lost <= 0.5 * every:
            text = "\n".join(x for x, p in lines_of(r[1]) if p not in gone) if gone else r[1]
            out.append((*r[:1], text, *r[2:4], len(text) if gone else r[4], *r[5:]))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def made():
    return rows()


def test_quality_rules(spark, made):
    out = pipeline.quality_rules(spark, spark.createDataFrame(made, SCHEMA), "")
    assert out.columns == COLUMNS
    want = cleaned(made)
    assert collected(out) == sorted(want, key=key) and len(want) > 100 and any("Home" in (r[1] or "") for r in made) and not any("Home" in r[1] for r in want if r[3] == "hot")


def test_near_duplicates(spark, made):
    out = pipeline.near_duplicates(spark, spark.createDataFrame(made, SCHEMA), "")
    assert out.columns == COLUMNS
    keep = {i for i, _, c in brute(made, 5, 80) if i == c}
    want = {r for r in made if r[0] is None or str(r[0]) in keep}
    assert collected(out) == sorted(want, key=key) and len(want) < len(made) - 20


def test_secret_scan(spark, made):
    out = collected(pipeline.secret_scan(spark, spark.createDataFrame(made, SCHEMA), ""))
    assert len(out) == len(made)
    text = {(r[0], r[5]): r for r in made}
    for r in out:
        old = text[r[0], r[5]]
        assert r[2:4] + r[5:] == old[2:4] + old[5:] and (r[1] is None) == (old[1] is None)
        if old[1] and "api_key" in old[1]:
            assert "api_key" not in r[1] and "[secret]" in r[1] and r[4] == len(r[1])
        elif not (old[1] and sc.spans(old[1])[1]):
            assert r == old


def test_mix_sources(spark, made):
    out = [tuple(r) for r in pipeline.mix_sources(spark, spark.createDataFrame(made, SCHEMA), "").collect()]
    assert set(out) <= set(made)
    words, sizes, taken, most = (lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in made:
        sizes[r[3]] += words(r[1])
        most[r[3]] = max(most[r[3]], words(r[1]))
    for r in out:
        taken[r[3]] += words(r[1])
    given, got = Counter(made), Counter(out)
    assert all(n <= 3 * given[r] for r, n in got.items())
    for source, target in wanted(sizes).items():
        assert abs(taken[source] - target) <= 3 * most[source], source
    assert [r for r in pipeline.mix_sources(spark, spark.createDataFrame(made, SCHEMA), "").collect()] == [r for r in out]


def test_encode_pieces(spark, made):
    out = pipeline.encode_pieces(spark, spark.createDataFrame(made, SCHEMA), "").collect()
    assert len(out) == len(made) and all(r.round_trip and len(r.ids) == r.n_tokens for r in out)
    assert Counter((r.doc_id, r.source, r.n_chars) for r in out) == Counter((r[0], r[3], len(r[1] or "")) for r in made)


def test_run_and_empty(spark, made, tmp_path):
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows_ = pipeline.run(spark, str(tmp_path)).collect()
    assert rows_ and all(r.round_trip for r in rows_)
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
