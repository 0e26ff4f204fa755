"""SuperMinHash signatures over word shingles.

An element of a set draws, for level j = 0, 1, ..., a fresh fraction and the next
entry of its own random permutation of the m slots, and offers j + fraction to
the slot drawn. A slot keeps its least offer. Ranks within one element never
coincide, which lowers the variance against m independent hashes, and once every
slot of a set holds an offer below j + 1 no later level can matter, so large sets
stop after a level or two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from larkspur.llm.common import LOWER, gram_hashes, mix, text_runs, word_hashes, word_spans

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _gold(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)
#: Elements whose permutations are held at once.
ELEMENTS = 100_000


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each document's begin (one more entry than documents).

    Letters A to Z are lowered first. A document of fewer than k words has its whole sequence as its one shingle, without words none.
    """
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends)
    grams = gram_hashes(words, k)
    sets, at = [], first.tolist()
    for a, b in zip(at, at[1:]):
        if b - a >= k:
            part = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            sets.append(part[keep])
        elif b > a:
            sets.append(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            sets.append(words[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([words[:0], *sets]), np.concatenate([[0], np.cumsum(sizes)])


def _signatures(elements: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    least = np.full(sets * m, ~np.uint64(0))
    rows = np.arange(len(elements))
    order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(elements), m)).copy().ravel()
    for j in range(m):
        draw = mix(elements + _gold(j + 1))
        k = j + (((draw & _LOW) * np.uint64(m - j)) >> _HIGH).astype(np.intp)
        base = rows * m
        slot = order[base + k]
        order[base + k] = order[base + j]  # entry j itself is not looked at again
        np.minimum.at(least, owner * m + slot, (np.uint64(j) << _HIGH) | (draw >> _HIGH))
        done = (least.reshape(sets, m) < (np.uint64(j + 1) << _HIGH)).all(1)
        on = ~done[owner]
        if not on.all():
            elements, owner, rows = elements[on], owner[on], rows[on]
            if not len(elements):
                break
    return least.reshape(sets, m)


def signatures(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """The m slots of each set, as level and fraction in one number. Sets larger than ELEMENTS are taken in parts and their slots' minima joined."""
    sets = len(first) - 1
    out = np.full((sets, m), ~np.uint64(0))
    at = 0
    while at < sets:
        to = max(at + 1, int(np.searchsorted(first, first[at] + ELEMENTS, "right")) - 1)
        owner = np.repeat(np.arange(to - at), np.diff(first[at : to + 1]))
        part = elements[first[at] : first[to]]
        for cut in range(0, len(part), ELEMENTS):
            np.minimum(out[at:to], _signatures(part[cut : cut + ELEMENTS], owner[cut : cut + ELEMENTS], to - at, m), out=out[at:to])
        at = to
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of that many slots; the band's number is part of it."""
    sets, m = signature.shape
    bands = signature.reshape(sets, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (sets, m // rows)) * _GOLD
    for r in range(rows):
        key = mix(key + bands[:, :, r] + _GOLD)
    return key


def sketch_batches(batches: Iterator[pa.RecordBatch], k: int, m: int, rows: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, version): doc_id, version, n_shingles, two digests of the set, and band keys."""
    for batch in batches:
        for begin, end, buf, offsets in text_runs(batch.column(1)):
            elements, first = shingle_sets(buf, offsets, k)
            keys = band_keys(signatures(elements, first, m), rows)
            digests = []
            for salt in (1, 2):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements + _gold(salt)))])
                digests.append(pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)))
            n = end - begin
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * keys.shape[1] + 1, keys.shape[1]).astype(np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), batch.column(2).slice(begin, n), pa.array(np.diff(first)), *digests, lists], ["doc_id", "version", "n_shingles", "digest1", "digest2", "bands"])


def set_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text): doc_id and the sorted shingle hashes."""
    for batch in batches:
        for begin, end, buf, offsets in text_runs(batch.column(1)):
            elements, first = shingle_sets(buf, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(elements.view(np.int64)))], ["doc_id", "shingles"])
