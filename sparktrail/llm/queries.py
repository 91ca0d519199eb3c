"""The queries of the corpus operators: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import byte_pairs, centroids, collocations, fingerprints, html, jaccard_join, mixing, packing, quality, secrets, sharding, suffix_dedup, unigram
from .common import table


def op7_unigram_pieces(spark, sf_dir):
    return unigram.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_deep_shallow_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_random_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"))


def op1_line_blocks(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"), 3, 90)


def op3_piecewise_hashes(spark, sf_dir):
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op4_packed_ids(spark, sf_dir):
    return packing.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_curriculum_mix(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op6_minimax_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_phrase_tries(spark, sf_dir):
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_recursive_bpe(spark, sf_dir):
    return byte_pairs.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_weighted_lloyd(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_blocks, op2_jaccard_join, op3_piecewise_hashes, op4_packed_ids, op5_curriculum_mix, op6_minimax_shards, op7_unigram_pieces, op8_deep_shallow_dedup, op9_random_secrets, op10_quality_rules, op11_phrase_tries, op12_recursive_bpe, op13_weighted_lloyd)}
ORACLES: dict[str, str] = {
    "op11_phrase_tries": collocations.SQL,
    "op13_weighted_lloyd": centroids.sql(),
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) o(k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
 list_transform(string_split(lower(regexp_replace(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')), chr(10)), lambda x: trim(x, ' ')) AS plain FROM d),
x AS (SELECT d.r, d.source, d.t, unnest(plain) AS line FROM l JOIN d USING (r)),
held AS (SELECT source, line, count(DISTINCT t) AS docs FROM x WHERE line <> '' GROUP BY ALL),
size AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY ALL),
f AS (SELECT held.source, held.line FROM held JOIN size ON held.source IS NOT DISTINCT FROM size.source WHERE docs > 2 AND docs > 0.05 * n),
gone AS (SELECT r, sum(length(x.line)) AS n FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source AND x.line = f.line GROUP BY r),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_chars, CAST(coalesce(list_sum(list_transform(plain, lambda y: length(y))), 0) AS BIGINT) AS line_chars
 FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN gone USING (r)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND removed_chars <= 0.5 * line_chars AS kept FROM c""",
}
