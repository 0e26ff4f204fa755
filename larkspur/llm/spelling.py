"""Grouping of spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted over whole texts. Every word proposes its edits, by hash
alone: those that a deletion gives, and those that put a later letter of the alphabet
in place of one of its own, which reaches each pair of near words from one side.
Edits are probed in blocked Bloom filters, one shard for each length of word, that
are broadcast; only hits are shuffled, to a join with the vocabulary that removes
what the filters let through by chance, and every pair is confirmed letter by
letter. A filter never exceeds ``FILTER_BYTES``: a larger vocabulary is probed in
several passes, each with the filter of one part of it.

Hashes are polynomials in the code points, so that each edit's hash follows from the
word's prefix sums in one step, however long the word. Two words of one hash cost
extra comparisons, never a wrong result.

Runs are ``[A-Za-z\\u00C0-\\u00FF]+``; only A-Z are lower-cased. Null and empty texts
have no words, a null id counts as an empty string where runs are altered; rows
that repeat an id each count; of near words of one count the first in code point
order is the form; an empty table, or one without words of the length, gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hinted, materialise, mix

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points that words are made of.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Whole runs of that length: a match starts where its run does, as it could not start later in one that is shorter.
RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"

#: Largest filter that is broadcast, bits for each word in it, and the length from which on all words share a shard.
FILTER_BYTES, WORD_BITS, LAST_SHARD = 64 << 20, 24, 255
#: Blocks (of 64 bytes) of a filter that are built together; letters whose edits are made at once; words of a task.
SEGMENT, LETTERS, TASK_WORDS = 2048, 1 << 11, 20_000

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 31) -> DataFrame:
    """word: each lower-cased run of at least LEAST_LENGTH letters; where the checksum of id and run is a multiple of ``rate``, one letter is left out."""
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))
    given = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return given.withColumn("h", h).select(F.when(F.col("h") % rate == 0, less).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)


class _Letters:
    """The letters of a run of words, and what hashes of their edits are made from."""

    def __init__(self, batch: list[str]):
        self.size = np.array([len(w) for w in batch])
        self.code = np.frombuffer("".join(batch).encode("utf-32-le"), "<u4").astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(batch)), self.size)
        longest = int(self.size.max(initial=1))
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, _BASE, np.uint64))])
        back = self.size[self.word] - 1 - (np.arange(len(self.code)) - self.first[self.word])
        self.power = powers[back]
        value = _VALUES[self.code]
        term, shifted = value * self.power, value * powers[np.maximum(back - 1, 0)]
        self.sum = np.add.reduceat(term, self.first) if len(batch) else np.empty(0, np.uint64)
        # Sums up to each letter, without those of the words before.
        upto, before = np.cumsum(term), np.cumsum(shifted) - shifted
        upto -= (upto - term)[self.first][self.word]
        before -= before[self.first][self.word]
        self.without = before + (self.sum[self.word] - upto)

    def keys(self) -> np.ndarray:
        return mix(self.sum)

    def edits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For bounded runs of letters: the words edited, lengths and keys of what results."""
        for at in range(0, len(self.code), LETTERS):
            part = slice(at, at + LETTERS)
            word = self.word[part]
            yield word, self.size[word] - 1, mix(self.without[part].copy())
            rows, letters = np.nonzero(ALPHABET[None, :] > self.code[part][:, None])
            change = _VALUES[ALPHABET[letters]] - _VALUES[self.code[part]][rows]
            word = word[rows]
            yield word, self.size[word], mix(self.sum[word] + change * self.power[part][rows])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)


class Filter:
    """Blocked Bloom filters, one shard for each length: a key sets four bits in two of the eight numbers of its block."""

    def __init__(self, counts: dict[int, int], parts: int = 1):
        blocks = np.zeros(LAST_SHARD + 1, np.int64)
        for size, count in counts.items():
            blocks[min(size, LAST_SHARD)] += count
        self.blocks = -(-blocks * WORD_BITS // (512 * parts))
        self.first = np.cumsum(self.blocks) - self.blocks
        self.parts = parts
        self.bits: np.ndarray | None = None

    @property
    def bytes(self) -> int:
        return 64 * int(self.blocks.sum())

    def places(self, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each key, and whether its length has a shard."""
        shard = np.minimum(sizes, LAST_SHARD)
        blocks = self.blocks[shard]
        inside = ((keys >> np.uint64(32)) * blocks.view(np.uint64)) >> np.uint64(32)
        return self.first[shard] + inside.view(np.int64), blocks > 0

    @staticmethod
    def mark(keys: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray]:
        """The first or second number of its block that a key looks at, and its bits there."""
        take = lambda shift, mask: (keys >> np.uint64(shift)) & np.uint64(mask)
        one = np.uint64(1)
        return take(3 * nth, 7).view(np.int64), one << take(6 + 12 * nth, 63) | one << take(12 + 12 * nth, 63)

    def holds(self, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Indexes of keys that may be in the filter."""
        block, there = self.places(sizes, keys)
        on = np.flatnonzero(there)
        if len(on) < len(keys):
            keys, block = keys[on], block[on]
        for nth in range(2):
            number, bits = self.mark(keys, nth)
            hit = np.flatnonzero(self.bits[block * 8 + number] & bits == bits)
            on, keys, block = on[hit], keys[hit], block[hit]
        return on


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = _Letters(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(letters.size.astype(np.int32)), pa.array(letters.keys().view(np.int64))], ["word", "n", "size", "key"])


def _segments(shape: Filter, part: int):
    """Rows (size, key) as (segment, block, key) of one part of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            mine = _part(keys, shape.parts) == part
            block, _ = shape.places(batch.column(0).to_numpy()[mine], keys[mine])
            yield pa.RecordBatch.from_arrays([pa.array(block // SEGMENT), pa.array(block % SEGMENT), pa.array(keys[mine].view(np.int64))], ["segment", "block", "key"])

    return run


def _fill(group: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT * 8, np.uint64)
    block = group.column("block").to_numpy()
    for nth in range(2):
        number, mask = Filter.mark(group.column("key").to_numpy().view(np.uint64), nth)
        np.bitwise_or.at(bits, block * 8 + number, mask)
    return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _build(keyed: DataFrame, shape: Filter, part: int) -> None:
    """Fill a filter by segments, each of which one task has; together they have at most FILTER_BYTES."""
    shape.bits = np.zeros(int(shape.blocks.sum()) * 8, np.uint64)
    parts = keyed.select("size", "key").mapInArrow(_segments(shape, part), "segment bigint, block bigint, key bigint")
    for row in parts.groupBy("segment").applyInArrow(_fill, "segment bigint, bits binary").toLocalIterator():
        at = row.segment * SEGMENT * 8
        filled = np.frombuffer(row.bits, np.uint64)[: len(shape.bits) - at]
        shape.bits[at : at + len(filled)] = filled


def _probe(shared, part: int):
    """Rows (word, key) as pairs of keys (a, b): b may be a word, and is an edit of a's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape: Filter = shared.value
        for batch in batches:
            own = batch.column(1).to_numpy()
            for word, size, key in _Letters(batch.column(0).to_pylist()).edits():
                if shape.parts > 1:
                    mine = np.flatnonzero(_part(key, shape.parts) == part)
                    word, size, key = word[mine], size[mine], key[mine]
                hit = shape.holds(size, key)
                if len(hit):
                    pairs = np.unique(np.stack([own[word[hit]], key[hit].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _parallel(df: DataFrame, rows: int) -> DataFrame:
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_WORDS)))


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """From distinct words (word, n): (word, n, other, other_n) for all words that one edit makes into each other, in both orders."""
    spark = vocabulary.sparkSession
    keyed = materialise(vocabulary.select("word", "n").mapInArrow(_keyed, "word string, n bigint, size int, key bigint"), "words")
    counts = {r["size"]: r["count"] for r in keyed.groupBy(F.least("size", F.lit(LAST_SHARD)).alias("size")).count().collect()}  # one row a shard
    parts = max(1, -(-Filter(counts).bytes // filter_bytes))
    proposed = []
    asking = _parallel(keyed.select("word", "key"), sum(counts.values()))
    for part in range(parts):
        shape = Filter(counts, parts)
        _build(keyed, shape, part)
        shared = spark.sparkContext.broadcast(shape)
        proposed.append(materialise(asking.mapInArrow(_probe(shared, part), "a bigint, b bigint"), "proposed"))
        shared.destroy()
    hits = reduce(DataFrame.unionByName, proposed)
    other = keyed.select(F.col("key").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = hits.join(other, "b").join(keyed.select(F.col("key").alias("a"), "word", "n"), "a")
    found = materialise(found.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct(), "pairs")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form, from (word, form): each round follows twice as many forms. Counts rise tenfold at each form, so few rounds are enough."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = hinted(now.select(F.col("word").alias("__at"), F.col("root").alias("__next")))
        joined = now.join(further, F.col("root") == F.col("__at"), "left")
        then = materialise(joined.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if then.filter("moved").isEmpty():
            return then.drop("moved")
        now = then.drop("moved")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of at least LEAST_LENGTH letters that occurs LEAST_COUNT times or more."""
    counted = words(df, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)
    vocabulary = materialise(counted, "vocabulary")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("bigint").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))))
    near = near_pairs(vocabulary).unionByName(alone).groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("best"))
    formed = F.coalesce(-F.col("best.n") >= ratio * F.col("n"), F.lit(False))
    told = materialise(near.select("word", "n", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(told.filter("form is not null").select("word", "form")).withColumnRenamed("word", "__word")
    return told.join(ends, F.col("word") == F.col("__word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
