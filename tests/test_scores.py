"""Scores that SQL cannot state, against plain Python on whole tables."""

import math
from collections import Counter

import pytest

from larkspur import registry
from larkspur.functions import score
from larkspur.functions.python import sequence_ratio
from pyspark.sql import functions as F


def bleu(reference, candidate):
    r, c = reference.lower().split(), candidate.lower().split()
    if not r or not c:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        own, other = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (c, r))
        logs += math.log(((own & other).total() or 0.1) / max(1, own.total())) / 4
    return min(1.0, math.exp(1 - len(r) / len(c))) * math.exp(logs)


def test_bleu(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    out = registry.QUERIES["f14_bleu"](spark, sf).collect()
    assert {r.item_id for r in out} == {i for i in texts if i + 1 in texts}
    for r in out:
        assert r.bleu == pytest.approx(bleu(texts[r.item_id], texts[r.item_id + 1]), abs=1e-6) and r.own == pytest.approx(bleu(texts[r.item_id], texts[r.item_id]), abs=1e-6)


@pytest.mark.parametrize("pair", [("a b c a b c d", "a b c a b x"), ("a a a a", "a a"), ("a a", "a a a a a a"), ("a", "A"), ("", "a"), ("a", " "), ("x y", "z w")])
def test_bleu_of_repeats_and_short_texts(spark, pair):
    got = spark.createDataFrame([pair], "r string, c string").select(score.bleu(F.col("r"), F.col("c"))).first()[0]
    assert got == pytest.approx(bleu(*pair), abs=1e-12)


def test_bleu_of_nulls(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None)], "r string, c string")
    assert [r.x for r in rows.select(score.bleu(F.col("r"), F.col("c")).alias("x")).collect()] == [None, None]


def test_fuzzy_match(spark, sf):
    """Every pair; the ratio of two texts without a repeated word is twice the matching characters over both lengths."""
    known = [(" ABCD ", "bcde", 0.75), ("abc", "xyz", 0.0), ("", "", 1.0), (None, "a", 0.0), ("Paris", "paris ", 1.0)]
    got = spark.createDataFrame(known, "a string, b string, r double").select(sequence_ratio("a", "b").alias("x"), "r").collect()
    assert all(g.x == pytest.approx(g.r) for g in got)
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    out = registry.QUERIES["f3_fuzzy_match"](spark, sf).collect()
    assert len(out) == sum(r.role == "user" and (c, t + 1) in turns and turns[c, t + 1].role == "assistant" for (c, t), r in turns.items())
    assert all(r.correct == (r.ratio >= 0.8) and 0 <= r.ratio <= 1 for r in out)
