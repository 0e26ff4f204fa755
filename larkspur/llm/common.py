"""Shared pieces of the text operators: tables, scratch space and vectorised word kernels.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. All kernels work on the
UTF-8 bytes of an Arrow string column, a bounded run of documents at a time.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20

#: Largest table of plain ids (a few numbers a row, so some 10 MB in memory), in rows, that is broadcast; beyond it joins shuffle.
BROADCAST_IDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: dict[str, SparkSession] = {}


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(_sweep)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/larkspur-{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder once and read back, so that a lost executor costs only its own tasks."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> bool:
    """Whether a materialised table of narrow rows is within the broadcast bound."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast a narrow materialised table if its counted size allows it; else leave it to a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def text_runs(column: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string or binary column: first row, end row, bytes, offsets from 0. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if binary.null_count:
        binary = binary.fill_null(b"")
    _, offsets, data = binary.buffers()
    ends = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(binary):
        to = int(np.searchsorted(ends, ends[at] + chunk, "right")) - 1
        to = min(max(to, at + 1), len(binary))
        yield at, to, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def slabs(batch: pa.RecordBatch, column: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about 8 MB of text each, so that what a worker holds at once is bounded by that or by one document."""
    at = 0
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and for each document the index of its first word (one more entry than documents)."""
    n = len(buf)
    solid = ~_SPACE[buf]
    before = np.empty(n, bool)
    before[1:] = solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    if n:
        before[0] = False
        before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[:-1] = solid[1:]
    if n:
        after[-1] = False
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the low n bytes of eight
#: Spans of more bytes are hashed one by one with BLAKE2.
LONG_SPAN = 256


def wide_view(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def word_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """128-bit hashes of byte spans as two numbers each, the same wherever a span stands.

    Eight bytes at a time enter two states that feed each other; each step is a
    bijection with a non-linear mixer, so no structure of a text cancels, and spans
    of up to eight bytes and one length never coincide. The second number is left out if not asked for.
    """
    wide, length = wide_view(buf), ends - starts
    n = length.astype(np.uint64)
    chunk = wide[starts] & KEEP[np.minimum(length, 8)]
    one = mix(chunk ^ (n * _GOLD))
    second = lambda chunk, n: mix(chunk + n * _ODD + _GOLD)
    two = second(chunk, n) if both else None
    on = np.flatnonzero((length > 8) & (length <= LONG_SPAN))
    if len(on):
        a, b, at = one[on], second(chunk[on], n[on]), 8
        start, rest = starts[on], length[on] - 8
        while len(on):
            chunk = wide[start + at] & KEEP[np.minimum(rest, 8)]
            a, b = mix((a ^ chunk) + b * _ODD), mix((b + chunk * _GOLD) ^ (a >> np.uint64(7)))
            more = rest > 8
            if not more.all():
                done = on[~more]
                one[done] = a[~more]
                if both:
                    two[done] = b[~more]
                on, start, rest, a, b = on[more], start[more], rest[more], a[more], b[more]
            rest = rest - 8
            at += 8
    for k in np.flatnonzero(length > LONG_SPAN).tolist():
        digest = np.frombuffer(hashlib.blake2b(buf[starts[k] : ends[k]], digest_size=16).digest(), "<u8")
        one[k] = digest[0]
        if both:
            two[k] = digest[1]
    return one, two


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: the first half of word_digests."""
    return word_digests(buf, starts, ends, both=False)[0]


_ROLL = [np.uint64(x) for x in (mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1))]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words (len - k + 1 of them, none if fewer), from one half of their digests."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for t in range(k):
        h += words[t : t + n] * _ROLL[t]
    return mix(h)


def within(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each gram start of a run of documents: whether its k words are of one document. first: index of each document's first word, and the end."""
    ok = np.ones(max(total - k + 1, 0), bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1) : b] = False
    return ok
