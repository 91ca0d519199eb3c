from sparktrail.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def own(i):
    word = "".join(chr(97 + int(c)) for c in f"{i:04d}")
    return " ".join(f"{word}{a}{b}" for a in "abcdefgh" for b in "klmnopqr")


def test_one_rule_at_every_size(spark):
    """The same shares of hosts of 10, 60 and 500 documents: a line in 30 % goes, one in 2 documents of 60 and of 500 stays."""
    rows, menu, pair = [], "home news sport weather and contact", "a line that comes twice only"
    for host, n in (("small", 10), ("middle", 60), ("large", 500)):
        for k in range(n):
            lines = [own(len(rows))] + [menu] * (k % 10 < 3) + [pair] * (k < 2)
            rows.append((len(rows), "\n".join(lines), "en", host, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.query(df).collect()}
    for i, text, *_ in rows:
        assert got[i].kept and got[i].removed_chars == (len(menu) if menu in text else 0), i
    cleaned = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert not any(menu in t for t in cleaned.values()) and sum(pair in t for t in cleaned.values()) == 6
