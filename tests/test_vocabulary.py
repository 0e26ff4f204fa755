"""Word maps: injective over all words of the tables, and undone exactly. Prices and verdicts in plain Python."""

import random
import re

from pyspark.sql import functions as F

from larkspur.functions import score as S
from larkspur.functions import text as T
from larkspur.functions import transform as X
from larkspur.operators import vocabulary
from larkspur.plans import bridge, rewriting


def test_forms_are_unique_and_undone(spark, sf):
    v = bridge.views(spark, sf)
    forms = rewriting.forms(v).collect()
    words = {r.word for r in rewriting.words(v).collect()}
    assert {r.word for r in forms} == words and len({r.form for r in forms}) == len(forms) == len(words)
    plain = [r[0] for r in rewriting.words(v).select(X.pseudo_word(F.col("word"), "s", rewriting.CONSONANTS, rewriting.VOWELS)).collect()]
    assert len(set(plain)) < len(plain)  # without rounds some words share a form
    out = rewriting.round_trip(v).collect()
    assert all(r.restored for r in out) and len(out) == v.raw("documents").count()


def test_crowded_forms_and_known_ones(spark):
    """All words propose one form until they are told apart by length."""
    words = spark.createDataFrame([(w,) for w in ["a", "b", "c", "d", "d", None]], "word string")
    known = spark.createDataFrame([("a", "x"), ("z", "xx")], "word string, form string")
    out = vocabulary.unique_forms(words, lambda word, nth: F.lit("x" * (nth + 1)), known).collect()
    assert {(r.word, r.form) for r in out} == {("a", "x"), ("z", "xx"), ("b", "xxx"), ("c", "xxxx"), ("d", "xxxxx")}
    assert vocabulary.unique_forms(words.limit(0), lambda w, n: w).count() == 0


def test_recoded_odd_texts(spark):
    df = spark.createDataFrame([(1, "The cat, THE é-dog."), (2, None), (3, ""), (4, " .. ")], "i bigint, t string")
    table = spark.createDataFrame([("the", "gop"), ("dog", "nuv")], "word string, form string")
    assert {r.id: r.text for r in vocabulary.recoded(df, "i", "t", table).collect()} == {1: "gop cat, gop é-nuv.", 2: None, 3: "", 4: " .. "}


def test_prices(spark):
    prices = {"gpt": 1.0, "gpt-big": 9.0, "llama-70b-chat": 3.0}
    asked = ["gpt", "gpt-big", "x/gpt-big-2", "my-gpt", "llama", "other", None]
    cost, kind = S.price(F.col("m"), prices, 2.0)
    out = {r.m: (r.c, r.k) for r in spark.createDataFrame([(a,) for a in asked], "m string").select("m", cost.alias("c"), kind.alias("k")).collect()}
    assert out == {"gpt": (1.0, "exact"), "gpt-big": (9.0, "exact"), "x/gpt-big-2": (9.0, "part"), "my-gpt": (1.0, "part"), "llama": (3.0, "part"), "other": (2.0, "default"), None: (2.0, "default")}


def test_verdicts_of_mixed_texts(spark):
    rng = random.Random(0)
    parts = ["Yes", "the answer", "(2)", "2)", "3.", "A)", "(b)", "\n", "no", "because 4) of"]
    rows = [(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 3))), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 2)))) for _ in range(600)] + [(None, "x"), ("x", None)]

    def choice(t):
        return next((m.group(1) for f in S.CHOICES if (m := re.search(f, t))), None)

    def verdict(p, e):
        if p is None or e is None:
            return "none"
        p, e = p.strip().lower(), e.strip().lower()
        return "equal" if p == e else "contains" if e in p else "choice" if choice(p) and choice(p) == choice(e) else "none"

    got = [r[0] for r in spark.createDataFrame(rows, "p string, e string").coalesce(1).select(S.verdict(F.col("p"), F.col("e"))).collect()]
    assert got == [verdict(*r) for r in rows] and set(got) == {"equal", "contains", "choice", "none"}
    said = ["(C) it is", "B. and A)", "3) or", "none", "x5.", "(1) A."]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").coalesce(1).select(S.choice(F.col("s"))).collect()] == [choice(s) for s in said]


def test_list_items(spark):
    said = ["a, b;c", "a; b", "a and b", "1. one 2. two", "- x\n- y", "• x\n  * y", "whole", " , ", ""]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").coalesce(1).select(T.list_items(F.col("s"))).collect()]
    assert got == [["a", "b;c"], ["a", "b"], ["a", "b"], ["one", "two"], ["x", "y"], ["x", "y"], ["whole"], [], []]


def test_exchange_joins_distinct_words_of_shards(spark, monkeypatch):
    """Texts that repeat few words, in many shards or one: as plain Python has them, and what the join takes is a row a distinct word of a shard."""
    rng = random.Random(5)
    words = ["the", "cat", "dog", "É", "x1y", "no-form", "THE"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(400))) for k in range(60)] + [(60, None), (61, ""), (62, "\n the\r\n")]
    forms = {"the": "gop", "cat": "the", "dog": "nuv", "x": "y", "y": "x"}
    df, table = spark.createDataFrame(rows, "i bigint, t string"), spark.createDataFrame(list(forms.items()), "word string, form string")
    expected = {k: t and re.sub("[a-z]+", lambda m: forms.get(m[0], m[0]), t.lower()) for k, t in rows}
    for size in (vocabulary.SHARD_BYTES, 2000):
        monkeypatch.setattr(vocabulary, "SHARD_BYTES", size)
        out = vocabulary.exchanged(df, "i", "t", table, restore=True).collect()
        assert {r.id: r.text for r in out} == expected and all(r.restored for r in out) and len(out) == len(rows)
    wrong = spark.createDataFrame([("the", "q"), ("cat", "q")], "word string, form string")
    assert not all(r.restored for r in vocabulary.exchanged(df, "i", "t", wrong, restore=True).collect())
