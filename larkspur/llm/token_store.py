"""Token ids in ORC files.

A store is a folder of ORC files whose documents ascend by id from file to file
and within files. ORC writes id lists with integer run-length encoding, keeps a
row index for every few thousand rows and a Bloom filter on the document id, so
a reader can take stripes in parallel and a lookup skips files, stripes and row
groups by their metadata.

Null texts hold only the end id; repeated rows are kept, side by side; null
document ids come first; an empty table gives a store without rows. Only the id
and text columns are read, so other columns never clash.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import pretokens
from larkspur.llm.bpe import SliceCache, encode_column, lists
from larkspur.llm.common import slabs

#: Settings of the ORC writer: bytes of a stripe, rows between index entries, false positives of the Bloom filters.
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 2_000
BLOOM_FPP = 0.01


@lru_cache(2)
def library(path: str):
    """The tokenizer of a file, with the library's defaults."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def library_cache(path: str) -> SliceCache:
    """A cache that has the tokenizers library encode every slice it has not seen.

    The library splits a text by the same rule before it merges, so the ids of a
    text that holds no added token are those of its slices.
    """
    tokenizer = library(path)

    def encode(slices: list[bytes]) -> list[bytes]:
        done = []
        for at in range(0, len(slices), 2_000):
            texts = [s.decode("utf-8", "surrogatepass") for s in slices[at : at + 2_000]]
            found = tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)  # one result for all is cheaper than one each
            raw, ends = np.array(found.ids, "<i4").tobytes(), np.searchsorted(found.word_ids, np.arange(len(texts) + 1)).tolist()
            done += [raw[4 * a : 4 * b] for a, b in itertools.pairwise(ends)]
        return done

    return SliceCache(encode)


def encode_texts(column: pa.Array, path: str, classes: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows: ids, and where each row's begin. Rows that hold the literal of an added token are given to the library whole, which cuts them there."""
    whole = np.zeros(len(column), bool)
    for token in library(path).get_added_tokens_decoder().values():
        whole |= pc.fill_null(pc.match_substring(column, token.content), False).to_numpy(zero_copy_only=False)
    if not whole.any():
        yield from (part[:2] for part in encode_column(column, library_cache(path), classes))
        return
    for at, end in itertools.pairwise(np.append(np.flatnonzero(np.append(True, whole[1:] != whole[:-1])), len(whole)).tolist()):
        part = column.slice(at, end - at)
        if not whole[at]:
            yield from (part[:2] for part in encode_column(part, library_cache(path), classes))
        for text in part.to_pylist() if whole[at] else []:
            ids = np.array(library(path).encode(text, add_special_tokens=False).ids, "<i4")
            yield ids, np.array([0, len(ids)])


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each row."""
    grown = rows + np.arange(len(rows))
    out = np.full(len(ids) + len(rows) - 1, end_id, "<i4")
    keep = np.ones(len(out), bool)
    keep[grown[1:] - 1] = False
    out[keep] = ids
    return out, grown


def write(df: DataFrame, store: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, end each with end_id, and write the lists in ascending order of ids."""

    classes = pretokens.classes_of_file(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slabs(whole):
                parts = [with_end(ids, rows, end_id) for ids, rows in encode_texts(batch.column(1), tokenizer_path, classes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(parts, pa.int32())], ["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    # Texts are dealt by ranges of ids before they are encoded: a text is smaller than its ids.
    ordered = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ordered.mapInArrow(run, f"doc_id {kind}, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(store)
    )


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id and ids of every document; files are read stripe by stripe in parallel."""
    return spark.read.orc(store)


def lookup(spark: SparkSession, store: str, doc_ids: list[int]) -> DataFrame:
    """The documents named. The filter reaches the ORC reader, which skips by row index and Bloom filter."""
    return read(spark, store).filter(F.col("doc_id").isin(doc_ids))


def index(spark: SparkSession, store: str) -> DataFrame:
    """For each document, read back: start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["file", "doc_id", "n_tokens", "ids_crc32"])

    stored = read(spark, store).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids")
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"file string, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")


def starts(rows: DataFrame) -> DataFrame:
    """Add start to materialised rows of index(). Files hold ranges of ids, so sums within files and over files suffice."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least"))
    base = files.select("file", (F.sum("tokens").over(Window.orderBy(F.asc_nulls_first("least"), "file")) - F.col("tokens")).alias("base"))
    within = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
