import re

from sparktrail.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {w: wins.count(w) for w in set(wins)}
    hit = {p for i, w in enumerate(wins) if count[w] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def rows():
    long = " ".join(f"w{i % 997} é{i}" for i in range(3000))
    repeats = " ".join(f"a{i % 90}" for i in range(400)) + " " + " ".join(f"b{i}" for i in range(500))
    texts = [None, "", "a a a a", "x y z x y z q", " \t\nline\nline\n \n \nline", "a b #*$ c d", long, repeats, "many " * 60]
    notes = ["Note 12 " + " ".join(f"{a}{b}" for b in "abcdefghi") for a in "mnopqr"]
    texts += ["\n".join([*notes, *(" ".join(f"own{i}{j}{k}z" for k in "abcdefghijklmnop") for j in range(8))]) for i in map(chr, range(97, 122))]
    texts += ["\n".join([x.replace("12", str(i)).upper() for x in notes] + [f"tiny {i} one two"]) for i in range(2)]
    out = [(i, t, "en", "s" if i % 40 else None, len(t or ""), "extra") for i, t in enumerate(texts)]
    return out + [out[7], (None, "null id " * 3, None, None, None, None)]


def test_base_and_limits(spark):
    data = rows()
    got = quality.query(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, text, *_ in data:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        assert not (r.base_failed and r.kept)
    assert by[10].kept and by[10].removed_chars == 6 * len("note 0 ma mb mc md me mf mg mh mi")
    assert [r.removed_chars for r in got if r.doc_id == 7] == [0, 0]
    assert not by[34].base_failed and not by[34].kept and by[34].line_chars > by[34].removed_chars == by[10].removed_chars


def test_clean_keeps_columns_and_drops_lines(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = quality.clean(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert 10 in got and "Note" not in got[10].text and got[10].n_chars == len(got[10].text) and got[10].n_words == "extra"
    assert 34 not in got and None not in got and 0 not in got
    kept = {r.doc_id for r in quality.query(df).filter("kept").collect()}
    assert kept == set(got)


def test_copies_do_not_count_as_boilerplate(spark):
    text = "\n".join(" ".join(f"{a}{b}" for b in "abcdefghijkl") for a in "mnopqr")
    df = spark.createDataFrame([(i, text, "en", "s", len(text), None) for i in range(100)], SCHEMA)
    assert quality.query(df).filter("kept").count() == 100


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.query(df).count() == 0 and quality.clean(df).count() == 0
