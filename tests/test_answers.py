"""Answers by kind, vocabularies by frequency, and texts of any length under scrambling."""

import hashlib
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur import registry
from larkspur.functions import evaluators
from larkspur.functions import text as T
from larkspur.functions import transform as X
from larkspur.functions.answers import transformed_answer
from larkspur.functions.python import sequence_ratio


def shifted(text):
    return "".join(chr((ord(c) - 97 + 3) % 26 + 97) if "a" <= c <= "z" else chr((ord(c) - 65 + 3) % 26 + 65) if "A" <= c <= "Z" else c for c in text)


DOC, NEW = "The Cat sat on a mat.", "The Fox sat on a mat."
CASES = [
    ("cat sat", "extractive", "fox sat", 1.0),
    ("the dog", "extractive", "the dog", 0.5 * 0.7),
    ("mat cat", "extractive", "mat fox", 0.5 * 0.7),
    ("A Cat sleeps", "abstractive", "A fox sleeps", 0.9),
    (" B ", "multiple_choice", " B ", 1.0),
    ("7", "multiple_choice", "7", 1.0),
    ("(b) cat", "multiple_choice", "(b) fox", 0.9),
    ("Yes", "yes_no", "Yes", 1.0),
    ("yes, cat", "yes_no", "yes, fox", 0.9),
    ("3.5", "numeric", "3.5", 1.0),
    ("-3.5", "numeric", "-3.5", 0.9),
    ("3 cat", "numeric", "3 fox", 0.9),
    ("cat, dog, and cow", "list", "fox, dog, and and cow", 0.9),
    ("cat; dog", "list", "fox, and dog", 0.9),
    ("cat", "list", "fox", 0.9),
    ("", "list", "", 1.0),
    ("", "abstractive", "", 0.9),
    (None, "abstractive", None, 0.9),
    ("cat", None, "fox", 0.9),
]


@pytest.mark.parametrize("translated", [False, True])
def test_answers_by_kind(spark, translated):
    df = spark.createDataFrame([(i, a, k) for i, (a, k, _, _) in enumerate(CASES)], "i int, a string, k string")
    told = (lambda c: X.caesar(c, 3)) if translated else None
    made = transformed_answer(F.col("a"), F.col("k"), F.lit(DOC), F.lit(NEW), {"cat": "fox"}, told)
    got = {r.i: (r.m.answer, r.m.confidence) for r in df.select("i", made.alias("m")).collect()}
    for i, (a, k, want, sure) in enumerate(CASES):
        stays = k in ("multiple_choice", "numeric") and sure == 1.0 or a == ""
        if translated and want is not None and not stays:
            want = shifted(want) if k != "list" else ", ".join(shifted(x) for x in want.split(", "))
            want = re.sub(r", dqg (?=\w+$)", ", and ", want) if k == "list" else want
        if i == 12 and translated:
            want = "ira, grj, and dqg frz"
        assert got[i][0] == want and abs(got[i][1] - sure) < 1e-12, (i, got[i], want)


def test_frequency_forms_are_short_for_frequent_words_and_unique(spark, sf):
    counts = Counter(w for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() for w in re.findall("[a-z]+", (t or "").lower()))
    found = {r.word: r.form for r in registry.QUERIES["t9_frequency_forms"](spark, sf).collect()}
    assert set(found) == set(counts) and len(set(found.values())) == len(found)
    most = max(counts.values())
    for word, form in found.items():
        assert len(form) >= 2 + (most // counts[word]).bit_length() - 1
    first = max(sorted(counts), key=counts.get)
    assert len(found[first]) == 2


def plain_scramble(text, level, seed, identity, symbols=X.SYMBOLS):
    places = [i for i, c in enumerate(text, 1) if re.fullmatch("[A-Za-z0-9]", c)]
    ranked = sorted(places, key=lambda i: (hashlib.md5(f"{seed}:{identity}:{i}".encode()).hexdigest(), i))
    chosen = set(ranked[: int(len(places) * level)])
    return "".join(symbols[i % len(symbols)] if i in chosen else c for i, c in enumerate(text, 1))


def test_scramble_is_linear_and_counts_differences(spark):
    texts = ["", "a", "!? ", "Ünïcode 😀 abc 123", "abc def", None, "word " * 40000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for level in (0.0, 0.3, 1.0):
        start = time.time()
        made = df.withColumn("s", X.scramble(F.col("t"), level, "s", F.col("i").cast("string"))).withColumn("d", T.differences(F.col("t"), F.col("s")))
        for r in made.collect():
            want = None if r.t is None else plain_scramble(r.t, level, "s", r.i)
            assert r.s == want, r.i
            assert r.d == (None if r.t is None else sum(a != b for a, b in zip(r.t, want)))
        assert time.time() - start < 60
    pairs = spark.createDataFrame([("abc", "abd"), ("abc", "ab"), ("", "xy"), (None, "xy"), ("😀a", "😀b"), (None, None)], "a string, b string")
    assert [r[0] for r in pairs.select(T.differences(F.col("a"), F.col("b"))).collect()] == [1, 1, 2, 2, 1, None]


def test_fuzzy_evaluator_agrees_with_the_ratio(spark):
    rows = [("hello world", "hello word"), ("abc", "xyz"), ("a" * 50, "a"), ("abcd", "dcba"), ("", ""), (None, "a"), ("The Answer", " the answer ")]
    df = spark.createDataFrame(rows, "p string, e string").withColumns({"fuzzy": evaluators.evaluated("fuzzy", F.col("p"), F.col("e")), "ratio": sequence_ratio("p", "e")})
    assert all(r.fuzzy == (r.ratio >= evaluators.ALIKE) for r in df.collect())
