"""Joins of the study's tables. Sizes decide the strategy: dimension tables are left to adaptive planning, which broadcasts what its statistics prove small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_questions(responses: DataFrame, scrambled: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses with the base question behind them, whether they answer it or a scrambled form of it.

    The either-or condition is resolved into one key first, so that both joins are equi-joins.
    """
    s = scrambled.select("scrambled_question_id", F.col("original_question_id").alias("_base"), "intensity")
    found = responses.join(s, "scrambled_question_id", "left").withColumn("question_id", F.coalesce("original_question_id", "_base"))
    q = questions.select("question_id", "domain", "benchmark_id", "n_words")
    return found.join(q, "question_id").select(
        *responses.columns, "question_id", F.lit("character").alias("method"), F.coalesce("intensity", F.lit(0.0)).alias("intensity"), "domain", "benchmark_id", "n_words"
    )


def unordered_pairs(df: DataFrame, key: str) -> DataFrame:
    """All pairs of distinct values of a small dimension, the lesser first."""
    names = df.select(key).distinct()
    return names.select(F.col(key).alias("a")).join(names.select(F.col(key).alias("b")), F.col("a") < F.col("b"))


def aligned_pairs(df: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """Values of two different keys on the same ``by``: ordered pairs."""
    left = df.select(F.col(key).alias("a"), by, F.col(value).alias("value_a"))
    right = df.select(F.col(key).alias("b"), by, F.col(value).alias("value_b"))
    return left.join(right, by).filter("a != b")
