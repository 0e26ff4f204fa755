"""Paraphrase candidates: pairs of texts of the benchmark table, a few places apart.

Likeness is the cosine of how often each letter occurs, the edit ratio and BLEU are those
of the texts, and the acceptance rule decides. The SQL has no BLEU: the rule asks for it
only where the edit ratio is below 0.25, and texts so alike share most four-grams.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import score as S

LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def one_byte(c: str) -> str:
    """SQL of a text whose letters outside ASCII are control characters, one for one: DuckDB's levenshtein counts bytes."""
    return f"translate({c}, '{OTHER_LETTERS}', {' || '.join(f'chr({k})' for k in [*range(1, 9), *range(14, 14 + len(OTHER_LETTERS) - 8)])})"


def counts_sql(c: str) -> str:
    return f"list_transform(range(97, 123), lambda k: CAST(length({c}) - length(replace({c}, chr(CAST(k AS INTEGER)), '')) AS DOUBLE))"


CANDIDATES = f"""WITH p AS (SELECT a.item_id, b.item_id AS candidate_id, a.text x, b.text y FROM benchmark a JOIN benchmark b ON b.item_id BETWEEN a.item_id + 1 AND a.item_id + 3),
candidates AS (SELECT *, cos_sim >= 0.85 AND edit_ratio >= 0.25 AS accepted FROM (SELECT item_id, candidate_id, round(list_cosine_similarity({counts_sql('x')}, {counts_sql('y')}), 6) cos_sim, round(levenshtein({one_byte('x')}, {one_byte('y')}) / greatest(length(x), length(y)), 6) edit_ratio FROM p))
"""


def letter_counts(c):
    return F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))).cast("double") for letter in LETTERS])


def candidates(v):
    """item_id, candidate_id, cos_sim, edit_ratio, bleu, accepted."""
    b = v.raw("benchmark")
    a = b.select("item_id", F.col("text").alias("x"), F.explode(F.array(*[F.col("item_id") + k for k in (1, 2, 3)])).alias("candidate_id"))
    both = a.join(b.select(F.col("item_id").alias("candidate_id"), F.col("text").alias("y")), "candidate_id")
    six = lambda c: F.round(c, 6)
    told = both.select("item_id", "candidate_id", six(S.cosine(letter_counts("x"), letter_counts("y"))).alias("cos_sim"), six(S.edit_ratio(F.col("x"), F.col("y"))).alias("edit_ratio"), S.bleu(F.col("x"), F.col("y")).alias("bleu"))
    return told.withColumn("accepted", S.accepted(F.col("cos_sim"), F.col("edit_ratio"), F.col("bleu")))
