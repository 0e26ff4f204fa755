"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``docs``. run() writes what a stage
returns and reads it back as the next one's input.

All stages take nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and further columns. Rows are told apart by id and text, so rows that
share an id with unlike texts are judged each by its own; rows with a null id are
never dropped as copies, and equal rows fare alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, dedup, mixing, quality, substrings
from larkspur.llm.common import hinted, materialise, table
from larkspur.session import ship


#: Similarity in percent from which the near-dedup stage links documents.
NEAR = 80


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose id and text (by its hash) are not in gone (doc_id, version)."""
    gone = hinted(materialise(gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).distinct(), "gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version")), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as empty ones; rows with a null id go like any other."""
    ship(spark)
    stats = materialise(quality.vectors(docs), "statistics")
    scored = quality.score(stats, quality.train(stats, table(spark, sf_dir, "labels")), threshold=0.7)
    return _without(docs, scored.filter("predicted = 0"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays. Texts without words, rows with a null id and repeated rows of the document that stays all stay."""
    ship(spark)
    return _without(docs, dedup.near_duplicates(docs, percent=NEAR, words=5).filter("not kept"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go. Changed texts have their words joined by one space, and their length in n_chars, where there is such a column; others, null and empty ones among them, stay as they are."""
    ship(spark)
    changed = substrings.remove_repeats(docs, keep_text=True).filter("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("kept").alias("__kept"))
    changed = materialise(changed.dropDuplicates(["__id", "__version"]), "changed")
    this = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    touched = hinted(changed.select("__id", "__version"))
    same = docs.join(touched, this, "left_anti")
    # Only rows that change meet the texts they change into.
    other = docs.join(touched, this, "left_semi").join(changed, this)
    now = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length("__kept").cast(docs.schema["n_chars"].dataType)
    return same.unionByName(other.withColumns(now).select(*[F.col(f"`{c}`") for c in docs.columns]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Texts without words have one copy; a null source is a source."""
    return mixing.apply(docs, mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text, with digests of the ids and of what they decode to; null and empty texts have none."""
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("substring dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: The classifier, shingle sets and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
