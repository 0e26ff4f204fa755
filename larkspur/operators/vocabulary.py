"""Word maps that can be undone: one form for each word, no form for two."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.scratch import scratch

RUNS = re.compile("[a-z]+")
#: Bytes of text, about, that meet their words' forms in one group.
SHARD_BYTES = 8 << 20


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_forms(words: DataFrame, propose: Callable[[Column, int], Column], known: DataFrame | None = None) -> DataFrame:
    """(word, form) for distinct words (word, and what ``propose`` reads of them, the same in all rows of a word); words and forms of ``known`` (word, form) stay as they are.

    In each round every word that has no form yet proposes one; of words with the same proposal the first in order of
    letters keeps it, forms that are taken go to nobody, and the others propose anew. ``propose(word, round)`` must give
    longer forms in later rounds, so that rounds end; they are few, and each writes its result.
    """
    spark = words.sparkSession
    out = known.select("word", "form") if known is not None else spark.createDataFrame([], "word string, form string")
    left, done, nth = _written(words.filter("word is not null").distinct().join(out, "word", "left_anti"), "words"), [], 0
    while not left.isEmpty():
        proposed = left.select("word", propose(F.col("word"), nth).alias("form")).join(out.select("form"), "form", "left_anti")
        won = _written(proposed.groupBy("form").agg(F.min("word").alias("word")).select("word", "form"), "forms")
        done.append(won)
        out = out.unionByName(won)
        left, nth = _written(left.join(won, "word", "left_anti"), "words"), nth + 1
    return out


def exchanged(df: DataFrame, id_col: str, text_col: str, forms: DataFrame, source: str = "word", target: str = "form", restore: bool = False) -> DataFrame:
    """(id, text): lower-cased texts with each run of a-z exchanged by the table, others kept; null texts stay null.

    With ``restore`` also whether exchanging the runs of the result by the table read the other way, which must have no form
    twice, gives the lower-cased text again. Texts are dealt into shards of a bounded size; a shard meets the part of the
    table that its distinct words ask for, so what is joined are a shard's distinct words, not the words of its texts.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    dealt = texts.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards))).repartition(shards, "_shard")
    asked = dealt.select(F.col("_shard").alias("_at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1))).alias("_from")).distinct()
    table = forms.select(F.col(source).alias("_from"), F.col(target).alias("_to")).filter("_to is not null")
    parts = asked.join(table, "_from")

    def swap(docs: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        there = dict(zip(part["_from"], part["_to"]))
        back = {b: a for a, b in there.items()}
        put = lambda table, text: RUNS.sub(lambda run: table.get(run[0], run[0]), text)
        out = docs[["id"]].assign(text=[None if t is None else put(there, t) for t in docs["text"]])
        if restore:
            out["restored"] = [new is None or put(back, new) == old for old, new in zip(docs["text"], out["text"])]
        return out

    kind = texts.schema["id"].dataType.simpleString()
    return dealt.groupBy("_shard").cogroup(parts.groupBy("_at")).applyInPandas(swap, f"id {kind}, text string" + ", restored boolean" * restore)


def recoded(df: DataFrame, id_col: str, text_col: str, forms: DataFrame, source: str = "word", target: str = "form") -> DataFrame:
    """(id, text): lower-cased texts with each run of a-z exchanged by the table, others kept. Null texts stay null."""
    return exchanged(df, id_col, text_col, forms, source, target)
