"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from larkspur.llm import audio, bpe, dedup, mixing, negatives, neighbours, quality, rules, spelling, substrings, token_store, toxicity
from larkspur.llm.common import materialise, scratch_path, table
from larkspur.llm.sharding import Store
from larkspur.session import ship


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), store, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.starts(materialise(token_store.index(spark, store), "token-index"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(audio.encode(table(spark, sf_dir, "documents")), "media")
    return audio.describe(stored).drop("frame_offsets")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality.vectors(table(spark, sf_dir, "documents")), "statistics")
    return quality.score(stats, quality.train(stats, table(spark, sf_dir, "labels")), threshold=0.7)


def op7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight lots, by the remainder of their id; the rows are read back from the newest manifest."""
    store = Store(spark, scratch_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"), F.coalesce(F.pmod("doc_id", F.lit(8)), F.lit(0)))
    store.vacuum()
    stored = store.read()
    return stored.select("doc_id", F.col("__arrival").alias("arrival"), F.col("__tier").alias("tier"), F.col("__run").alias("run"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, positives=5, negatives=5, label=label)


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under the newest policy, and which rule alone decides."""
    stored, policy = materialise(rules.ledger(table(spark, sf_dir, "documents")), "ledger"), rules.POLICIES[-1]
    return stored.select("*", (~rules.kept(rules.BASE)).alias("base_failed"), rules.kept(policy).alias("kept"), rules.decisive(policy).alias("decisive_rule"))


def _registered(*functions) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in functions}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = _registered(
    op1_near_dedup,
    op2_token_store,
    op3_neighbours,
    op4_toxicity,
    op5_audio,
    op6_quality,
    op7_compaction,
    op8_byte_bpe,
    op9_mixing,
    op10_substrings,
    op11_spelling,
    op12_hard_negatives,
    op13_rules,
)

ORACLE_SQL: dict[str, str] = {
    # Eight lots of similar size make two merges of four.
    "op7_compaction": """
        SELECT doc_id, CAST(doc_id % 8 AS INTEGER) AS arrival, 1 AS tier, 'L1-' || (doc_id % 8) // 4 AS run,
               CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
        FROM documents
    """,
    "op12_hard_negatives": """
        WITH r AS (
                 SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                        list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
                 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
             scored AS (
                 SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
                 FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
             positive AS (
                 SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
                 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM positive JOIN scored s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
        QUALIFY row_number() OVER best <= 5
    """,
    "op13_rules": """
        WITH given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
             words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM given),
             starts AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words),
             counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM starts),
             covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE c > 1) GROUP BY r),
             measured AS (
                 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
                 FROM words LEFT JOIN covered USING (r)),
             judged AS (
                 SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 5 * word_chars)::INT
                            + 8 * (100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
                            + 64 * (n_words > 100000)::INT + 128 * (n_lines = 1 AND n_words > 1000)::INT AS BIGINT) AS failed
                 FROM measured)
        SELECT *, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept,
               CASE failed & 63 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS decisive_rule
        FROM judged
    """,
}
