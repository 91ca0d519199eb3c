import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from sparktrail.llm import collocations


def brute(rows, longest=3, least=10, top=2000, cover=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, longest + 1):
                    if i + k <= len(ws):
                        f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, le, ri = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), le, ri))
        out += [(lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts():
    rng = random.Random(5)
    words = ["the", "The", "cat", "of", "é", "東京", "\x00", "\x01", "\x08x", "a\x01", "a", "ab", "sat", "zzz", "x\xa0y", "naïve"]
    rows = []
    for i in range(220):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(words) if rng.random() < 0.7 else "new york city")
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!?"]))
        rows.append((rng.choice(["en", "en", "en", "de", "und", None]), "".join(parts)))
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " .,"), ("en", "hot phrase here " * 400), ("en", "hot phrase here, " * 300)]
    return rows


def got(spark, rows, **extra):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS rank", "2 AS phrase", "3 AS n", "4 AS words")
    return sorted(tuple(r) for r in collocations.phrases(df, **extra).collect())


def test_equal_to_counting_all(spark):
    rows = texts()
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, longest=2, least=3, top=7) == brute(rows, longest=2, least=3, top=7)
    assert got(spark, rows, least=1, cover=30, top=50) == brute(rows, least=1, cover=30, top=50)


def test_small_shards_pieces_and_ranges(monkeypatch):
    """Texts over several shards, ranges inside one prefix, merges in many steps; run without Spark, as workers wouldn't see the patched limits."""
    rows = texts()
    for name, value in (("WORDS", 700), ("NODES", 16), ("PIECE_BYTES", 200), ("HELD", 40), ("PART", 50), ("RANGE_NODES", 64)):
        monkeypatch.setattr(collocations, name, value)
    pieces = list(local_pieces(rows))
    points = sorted({(lang, first) for lang, first, *_ in pieces})[::5]
    assert any(b"\0" in p for _, p in points)
    assert local_nodes(pieces, points, 2) == sorted(counted(rows, 2))


def local_pieces(rows):
    """What `tries` makes in one task, with the patched limits, without Spark."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def filter(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([a or "und" for a, t in rows if t is not None]), pa.array([t for _, t in rows if t is not None])], ["lang", "text"])
            return [tuple(r.values()) for b in run([batch]) for r in b.to_pylist()]

    return collocations.tries(Rows(), 3)


def local_nodes(pieces, points, least):
    import pyarrow as pa

    class Rows:
        sparkSession = None

        def __init__(self, batch):
            self.batch = batch

        def select(self, *_):
            return self

        def repartition(self, *_):
            return Rows(self.batch.sort_by([("range", "ascending"), ("lang", "ascending"), ("first", "ascending")]))

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, _):
            out = pa.Table.from_batches(run(self.batch.to_batches(max_chunksize=3)))
            return Rows(out)

    table = pa.Table.from_batches([collocations._rows(pieces, collocations.PIECES)])
    old, collocations.partitions = collocations.partitions, lambda _: 1
    try:
        out = collocations.merged(collocations.dealt(Rows(table), points), points, least)
    finally:
        collocations.partitions = old
    return sorted((r["lang"], r["phrase"], r["n"], tuple(r["lefts"])) for r in out.batch.to_pylist())


def counted(rows, least):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(ws)):
                for k in range(1, 4):
                    if i + k <= len(ws):
                        f[lang or "und"][tuple(ws[i : i + k])] += 1
    return [(lang, " ".join(p), n, tuple(c[p[:k]] for k in range(1, len(p)))) for lang, c in f.items() for p, n in c.items() if n >= least]


def test_very_long_text_and_word(spark):
    rows = [("en", "word " * 300_000 + "end. " + "x" * 3_000_000 + " tail"), ("en", "no break at all " * 20)]
    assert got(spark, rows, least=5) == brute(rows, least=5)


def test_sql_agrees(spark, tmp_path):
    rows = texts()
    path = str(tmp_path / "documents.parquet")
    df = spark.createDataFrame([(a, b.replace("\x00", "") if b else b) for a, b in rows], "lang string, text string")
    df.write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted(db.execute(collocations.SQL).fetchall()) == sorted(tuple(r) for r in collocations.phrases(df).collect())


def test_empty_and_wrong_lengths(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), ("en", "")]) == []
    with pytest.raises(ValueError):
        collocations.phrases(spark.createDataFrame([], "lang string, text string"), longest=5)
