"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each line is normalised (white space to one space, trimmed, lower case, digit runs to 0) and
hashed. Within a host (the `source` of a document; null is a host too) the distinct documents
that hold a line are counted; equal texts of a host count as one document, so exact copies do
not make their own lines look like boilerplate. A line held by more than
max(min_docs, share * documents of the host) is removed. A document that loses more than
`depleted` of its characters is rejected, as is one that fails the base rules.

Defined cases: a null text is an empty one, has no words and is rejected; repeated rows get the
same answer each; an empty table gives an empty result; unknown columns are ignored by
`signals` and passed on by `clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, join_sized, sized, text_col


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    repeat_percent: int = 50
    #: A line is boilerplate beyond this share of the distinct documents of its host ...
    share: float = 0.05
    #: ... and beyond this many of them, so that one pair in a tiny host isn't enough. From 40 documents on the share decides alone.
    min_docs: int = 2
    #: Share of a document's characters that removed lines may hold.
    depleted: float = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _lines(text: Column) -> Column:
    """Hash and length of each \\n-split line, normalised; empty lines have length 0."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0"))
    return F.transform(F.split(plain, "\n"), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.length(F.trim(x)).alias("n")))


def base_signals(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with `text`."""
    df = docs.withColumn("_t", text_col()).withColumn("_w", _words(F.col("_t")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # the hash of each 3-word window, at its first word
    df = df.withColumn(
        "_g",
        F.when(F.size("_h") > 2, F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_s", F.sort_array("_g"))
    df = df.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i + 1))))
    few = F.filter(F.transform("_g", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda p: p.isNotNull())
    pairs = F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_o", F.when(F.size("_d") > 64, pairs))
    many = F.sort_array(
        F.transform(
            F.filter("_o", lambda e, i: F.coalesce(e["x"] == F.get("_o", i + 1)["x"], F.lit(False)) | F.coalesce(F.when(i > 0, e["x"] == F.get("_o", i - 1)["x"]), F.lit(False))),
            lambda e: e["i"],
        )
    )
    df = df.withColumn("_p", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= 64, few).otherwise(many))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_w").cast("bigint")
    df = df.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
            "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
            "n_repeat_words": covered,
        }
    ).drop("_t", "_w", "_h", "_g", "_s", "_d", "_o", "_p", "_l")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def read_once(docs: DataFrame, work: Workspace, limits: Limits = Limits()) -> DataFrame:
    """doc_id, source, t (hash of the text), the base signals, line_chars and lines (hash and length of those that aren't empty), written: the only pass over the texts."""
    docs = docs.select("doc_id", "source", "text").withColumns({"t": F.xxhash64(text_col()), "lines": F.filter(_lines(text_col()), lambda x: x["n"] > 0)})
    base = base_signals(docs, limits).drop("text")
    return work.keep(base.withColumn("line_chars", F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])), "base")


def frequent_lines(base: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, h: the lines of each host that too many of its distinct documents hold. base: source, t, lines."""
    keyed = base.select(F.col("source").alias("host"), "t", "lines")
    lines = keyed.select("host", "t", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = lines.groupBy("host", "h", "t").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("docs"))
    size = keyed.groupBy("host", "t").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all_docs"))
    over = held.filter(F.col("docs") > limits.min_docs)  # only these can pass
    return (
        over.join(size.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
        .filter(F.col("docs") > limits.share * F.col("all_docs"))
        .select("host", "h")
    )


def _judged(base: DataFrame, work: Workspace, limits: Limits) -> DataFrame:
    """base with gone (hashes of the lines that go, null if none), removed_chars and kept."""
    frequent = work.keep(frequent_lines(base, limits), "frequent")
    lines = base.select("doc_id", "source", "t", F.explode("lines.h").alias("h")).withColumns({"k": F.coalesce("source", F.lit("")), "kn": F.col("source").isNull()})
    other = frequent.select(F.coalesce("host", F.lit("")).alias("k"), F.col("host").isNull().alias("kn"), "h")
    # a hot line is one row on the small side; when it is too large to broadcast, AQE splits the hot partition
    hits = join_sized(lines, other, ["k", "kn", "h"], "inner")
    # repeated rows of a document hold the same lines, so they are one here and judged alike
    gone = work.keep(hits.groupBy("doc_id", "source", "t").agg(F.collect_set("h").alias("gone")), "gone")
    gone = gone.select(F.col("doc_id").alias("d2"), F.col("source").alias("s2"), F.col("t").alias("t2"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("source").eqNullSafe(F.col("s2")) & (F.col("t") == F.col("t2"))
    joined = base.join(sized(gone), same, "left").drop("d2", "s2", "t2")
    zero = F.lit(0).cast("bigint")
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains("gone", x["h"])), zero, lambda a, x: a + x["n"])
    joined = joined.withColumn("removed_chars", F.when(F.col("gone").isNull(), zero).otherwise(lost))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("removed_chars") <= limits.depleted * F.col("line_chars")))


def signals(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document row: base signals, removed_chars, line_chars, kept."""
    work = Workspace(docs.sparkSession, "quality")
    return _judged(read_once(docs, work, limits), work, limits).drop("t", "lines", "gone")


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, without the lines above the limits; columns as given, n_chars brought up to date.

    Texts are read for the signals, and once more to be passed on; only what is rejected or changed is joined to them."""
    work = Workspace(docs.sparkSession, "quality-clean")
    judged = _judged(read_once(docs, work, limits), work, limits)
    side = judged.filter("NOT kept OR gone IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_host"), F.col("t").alias("_t1"), "gone", "kept").distinct()
    side = work.keep(side, "side")
    # the row travels whole in one column, so no name of its own can clash with ours
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", F.xxhash64(text_col()).alias("_k"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_host")) & (F.col("_k") == F.col("_t1"))
    rows = rows.join(sized(side), same, "left").filter("coalesce(kept, true)")
    text, hit = F.coalesce(F.col("_row")["text"], F.lit("")), lambda x: F.array_contains("gone", x["h"]) & (x["n"] > 0)
    left = F.array_join(F.zip_with(F.split(text, "\n"), _lines(text), lambda x, y: F.when(~hit(y), x)), "\n")  # nulls are left out
    changed = {"text": F.when(F.col("gone").isNull(), F.col("_row")["text"]).otherwise(F.col("_left"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("_row")["n_chars"]).otherwise(F.length("_left").cast(dict(docs.dtypes)["n_chars"]))
    rows = rows.withColumn("_left", F.when(F.col("gone").isNotNull(), left))
    return rows.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    kept = signals(docs)
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars", "line_chars")
