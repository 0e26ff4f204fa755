"""Byte-level BPE encoding and decoding with a rank file.

``encode`` and ``decode`` are DataFrame operators; ``round_trip`` does both in one
pass and keeps digests. Nulls are empty texts (no ids); very long texts are cut
into blocks only inside the boundary scan, never dropped; repeated rows give
repeated rows; an empty table gives an empty table. Only the named id and text
columns are read, so further columns never clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from larkspur.llm import pretokens
from larkspur.llm.common import KEEP, slabs, text_runs, wide_view, word_hashes

#: Slices longer than this are merged one at a time with a heap.
LONG_SLICE = 64
#: Distinct slices that a worker's cache holds, and bytes of them, before it starts anew; bytes of a slice that is kept.
CACHE_SLICES, CACHE_BYTES, CACHED_BYTES = 500_000, 32 << 20, 256
_NONE = np.int64(1 << 40)


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, rows: list[np.ndarray], kind: str):
        self.flat = np.concatenate([np.empty(0, kind), *rows]).astype(kind)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows named, one after another, and where each of them ends."""
        length = self.length[which]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[which] - (ends - length), length) + np.arange(total)], ends


class SliceCache:
    """Ids of slices, found by 64-bit hashes in an open-addressing table of arrays and confirmed byte for byte. Bounded: when full it starts anew."""

    SHIFT = np.uint64(64 - 21)

    def __init__(self, encode, size: int = CACHE_SLICES):
        self.encode, self.size = encode, size
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << 21, np.uint64)
        self.places = np.zeros(1 << 21, np.int32)
        self.ids, self.text = Ragged([], "<i4"), Ragged([], "u1")
        for kept, room in ((self.ids, 1 << 16), (self.text, 1 << 18)):
            kept.flat = np.zeros(room, kept.flat.dtype)
            kept.start, kept.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.heads = np.zeros(self.size + 1, np.uint64)  # the first eight bytes of each slice
        self.used, self.filled = [0, 0], 0

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, or the empty one where its search ended; and which were found."""
        slot = (hashes >> self.SHIFT).astype(np.intp)
        key = self.keys[slot]
        found = key == hashes
        on = np.flatnonzero(~found & (key != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[on]]
            found[on] = key == hashes[on]
            on = on[(key != 0) & (key != hashes[on])]
        return slot, found

    def _append(self, slices: list[bytes]) -> np.ndarray:
        """Encode slices and return the places of their ids."""
        count = len(slices)
        for which, (kept, rows) in enumerate(((self.ids, self.encode(slices)), (self.text, slices))):
            new = np.frombuffer(b"".join(rows), kept.flat.dtype)
            used, length = self.used[which], np.array([len(r) for r in rows], np.int64) // kept.flat.itemsize
            while used + len(new) + 8 > len(kept.flat):
                kept.flat = np.concatenate([kept.flat, np.zeros_like(kept.flat)])
            while self.filled + count > len(kept.start):
                kept.start = np.concatenate([kept.start, np.zeros_like(kept.start)])
                kept.length = np.concatenate([kept.length, np.zeros_like(kept.length)])
            kept.flat[used : used + len(new)] = new
            kept.start[self.filled : self.filled + count] = used + np.cumsum(length) - length
            kept.length[self.filled : self.filled + count] = length
            self.used[which] = used + len(new)
        heads = [int.from_bytes(s[:8], "little") for s in slices]
        if self.filled + count > len(self.heads):
            self.heads = np.concatenate([self.heads, np.zeros(self.filled + count, np.uint64)])
        self.heads[self.filled : self.filled + count] = heads
        self.filled += count
        return np.arange(self.filled - count, self.filled, dtype=np.int32)

    def _add(self, hashes: np.ndarray, slices: list[bytes]) -> None:
        place = self._append(slices)
        while len(hashes):
            slot, _ = self._slots(hashes)
            slot, first = np.unique(slot, return_index=True)  # of those that meet in a slot, one takes it
            self.keys[slot], self.places[slot] = hashes[first], place[first]
            hashes, place = np.delete(hashes, first), np.delete(place, first)

    def _same(self, buf: np.ndarray, starts: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which slices are byte for byte those of their places."""
        here = wide_view(buf)
        same = (self.text.length[places] == length) & (self.heads[places] == here[starts] & KEEP[np.minimum(length, 8)])
        there = np.ndarray((len(self.text.flat) - 7,), "<u8", self.text.flat, strides=(1,))
        on, at = np.flatnonzero(same & (length > 8)), 8
        a, b, rest = starts[on], self.text.start[places[on]], length[on] - 8
        while len(on):
            differ = ((here[a + at] ^ there[b + at]) & KEEP[np.minimum(rest, 8)]) != 0
            same[on[differ]] = False
            go = ~differ & (rest > 8)
            on, a, b, rest = on[go], a[go], b[go], rest[go] - 8
            at += 8
        return same

    def encode_run(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices of a run of text, and where each slice's ids end."""
        if len(bounds) > self.size + 1:  # one very long document: in parts that the table can hold
            parts = [self.encode_run(buf, bounds[at : at + self.size + 1]) for at in range(0, len(bounds) - 1, self.size)]
            before = np.cumsum([0] + [len(ids) for ids, _ in parts[:-1]])
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([ends + k for (_, ends), k in zip(parts, before)])
        starts, ends = bounds[:-1], bounds[1:]
        hashes = word_hashes(buf, starts, ends)
        hashes[hashes == 0] = 1
        short = ends - starts <= CACHED_BYTES
        slot, found = self._slots(hashes)
        cut = lambda which: [buf[a:b].tobytes() for a, b in zip(starts[which].tolist(), ends[which].tolist())]
        missing = np.flatnonzero(~found & short)
        if len(missing):
            distinct, sample = np.unique(hashes[missing], return_index=True)
            if (self.filled + len(distinct) > self.size or self.used[1] > CACHE_BYTES) and self.filled:
                self.clear()
                missing = np.flatnonzero(short)
                distinct, sample = np.unique(hashes[missing], return_index=True)
            self._add(distinct, cut(missing[sample]))
            slot, _ = self._slots(hashes)
        places = self.places[slot]
        # Long slices, and any whose hash is another's, are encoded by themselves and not kept.
        apart = ~short
        which = slice(None) if short.all() else short
        apart[which] = ~self._same(buf, starts[which], (ends - starts)[which], places[which])
        if not apart.any():
            return self.ids.gather(places)
        used, filled = list(self.used), self.filled
        which = np.flatnonzero(apart)
        places[which] = self._append(cut(which))
        found = self.ids.gather(places)
        self.used, self.filled = used, filled
        return found


class Ranks:
    """A vocabulary of byte strings with ranks, and its pair merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        ranks, pairs = self.ranks, []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.cache = SliceCache(self.merge_all)
        self.bytes = Ragged([np.frombuffer(t, np.uint8) for t in self.tokens], "u1")
        self.decimal = Ragged([np.frombuffer(f"{k},".encode(), np.uint8) for k in range(size)], "u1")

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_all(self, slices: list[bytes]) -> list[bytes]:
        """Ids of each slice: the whole slice if it is a token, else pairs of lowest rank merged first, the leftmost among equals."""
        out: list[bytes | None] = [None] * len(slices)
        batch = []
        for k, s in enumerate(slices):
            rank = self.ranks.get(s)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(s) > LONG_SLICE:
                out[k] = np.array(self.merge_long(s), "<i4").tobytes()
            else:
                batch.append(k)
        for at in range(0, len(batch), 50_000):
            self._merge_batch(slices, batch[at : at + 50_000], out)
        return out

    def _merge_batch(self, slices: list[bytes], which: list[int], out: list) -> None:
        lengths = np.array([len(slices[k]) for k in which], np.int64)
        which = np.array(which)
        tokens = self.byte_rank[np.frombuffer(b"".join(slices[k] for k in which), np.uint8)]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        rank = np.full(len(tokens), _NONE, np.int64)  # of the pair that starts here
        inner = np.ones(len(tokens), bool)
        inner[first + lengths - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.pair(tokens[at], tokens[at + 1])
        while len(which):
            # rank and place in one number, so that the minimum is the leftmost lowest
            best = np.minimum.reduceat((rank << 22) | np.arange(len(rank)), first)
            live = (best >> 22) < _NONE
            if not live.all():
                for w in np.flatnonzero(~live):
                    out[which[w]] = tokens[first[w] : first[w] + lengths[w]].astype("<i4").tobytes()
                keep = np.repeat(live, lengths)
                shift = np.cumsum(~keep)
                tokens, rank = tokens[keep], rank[keep]
                which, lengths, best = which[live], lengths[live], best[live]
                at = best & ((1 << 22) - 1)
                at = at - shift[at]
                merged = best >> 22
            else:
                at, merged = best & ((1 << 22) - 1), best >> 22
            if not len(which):
                break
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            end = first + lengths
            tokens[at] = merged
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, rank = tokens[keep], rank[keep]
            lengths = lengths - 1
            moved = np.arange(len(which))  # one token was dropped from each earlier slice
            at, first, end = at - moved, first - moved, end - moved - 1
            rank[at] = _NONE
            left = at[at > first]
            rank[left - 1] = self.pair(tokens[left - 1], tokens[left])
            right = at[at + 1 < end]
            rank[right] = self.pair(tokens[right], tokens[right + 1])

    def merge_long(self, s: bytes) -> list[int]:
        """One slice in n log n steps: a heap of pairs over a linked list."""
        ids = [int(self.byte_rank[b]) for b in s]
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        ranks, tokens = self.ranks, self.tokens

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return [ids[i] for i in range(n) if alive[i]]


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_column(column: pa.Array, cache: SliceCache, classes: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column: ids (int32), where each row's ids begin (one more entry than rows), byte offsets of slices in their rows, and where each row's slices begin."""
    for _, _, buf, offsets in text_runs(column):
        bounds, first = pretokens.split(buf, offsets, classes)
        if len(bounds) < 2:
            yield np.empty(0, "<i4"), np.zeros(len(offsets), np.int64), bounds[:0], first
            continue
        ids, ends = cache.encode_run(buf, bounds)
        rows = np.concatenate([[0], ends])[first]
        yield ids, rows, bounds[:-1] - np.repeat(offsets[:-1], np.diff(first)), first


def lists(parts: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.ListArray:
    """One list column from runs of flat values and their row offsets."""
    values = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
    sizes = np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return the id, ``ids`` (token ids) and ``slice_starts`` (byte offset of each pre-token) of each row."""
    id_type, classes = df.schema[id_col].dataType.simpleString(), pretokens.classes_of_tiktoken()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ranks(path).cache
        for whole in batches:
            for batch in slabs(whole):
                parts = list(encode_column(batch.column(1), cache, classes))
                columns = [batch.column(0), lists([p[:2] for p in parts], pa.int32()), lists([p[2:] for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "slice_starts"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, slice_starts array<bigint>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return the id and the decoded ``bytes`` of each row; null ids give no bytes."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ranks(path)
        for batch in batches:
            counts = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # about a million ids at once, or one row
                to = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + (1 << 20), "right")))
                part = batch.slice(at, to - at)
                flat, ends = codec.bytes.gather(part.column(1).flatten().to_numpy().astype(np.int64))
                edges = np.concatenate([[0], ends])[np.concatenate([[0], counts[at:to] - (counts[at - 1] if at else 0)])].tolist()
                view = memoryview(flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bytes(view[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())], [id_col, "bytes"])
                at = to

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, bytes binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text, decode its ids, and return the id, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and ``decoded_sha256``; ``ids`` as well if asked for."""
    id_type, classes = df.schema[id_col].dataType.simpleString(), pretokens.classes_of_tiktoken()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ranks(path)
        for whole in batches:
            for batch in slabs(whole):
                counts, digests, decoded, kept = [], [], [], []
                for ids, rows, _, _ in encode_column(batch.column(1), codec.cache, classes):
                    counts.append(np.diff(rows))
                    for table, out, cut in ((codec.decimal, digests, 1), (codec.bytes, decoded, 0)):
                        flat, ends = table.gather(ids)
                        view, at = memoryview(flat), np.concatenate([[0], ends])[rows].tolist()
                        out += [hashlib.sha256(view[a : b - cut if b > a else b]).hexdigest() for a, b in zip(at, at[1:])]
                    if keep_ids:
                        kept.append((ids, rows))
                columns = [batch.column(0), pa.array(np.concatenate([np.empty(0, np.int64), *counts])), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    columns.append(lists(kept, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return df.select(id_col, text_col).mapInArrow(run, schema)
