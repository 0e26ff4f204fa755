"""Removing passages that repeat across or within documents.

A window is ``window`` consecutive words of one document. A word is removed if a
window that covers it has its word sequence also at an earlier place: in a
document of smaller id, or earlier in the same one.

1. Copies of a whole word sequence need no windows: all but the first go.
2. Of each window the least hash among its ``anchor``-word grams is its anchor.
   Equal windows have equal anchors, and only about one gram in seven is one, so
   anchors that at least two documents share are found with a small shuffle.
3. Windows under shared anchors are confirmed as recurring by their own 128-bit
   hashes; the least document id that holds one is where it stays.
4. Each first document is cut once into passages: runs of recurring windows that
   the same documents repeat. A passage goes to its repeaters by its first window.
   Each shard of documents compiles the passages meant for it into an Aho-Corasick
   automaton and streams its texts through it, which locates every occurrence word
   for word. Documents to which nothing is sent only lose what they repeat within
   themselves.

Null, empty and short texts have no window and lose nothing; a very long text is
one place like any other. Rows that share an id count as one place: none removes
the other, whether their texts are equal or not. Rows with a null id are judged
only within themselves. Ties cannot occur, as places are distinct. An empty table
gives an empty result. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import gram_hashes, hinted, materialise, slabs, small, text_runs, within, word_digests, word_spans

WINDOW, ANCHOR = 20, 8
#: Characters of passages compiled into one automaton (of one document, if it has more).
SHARD_CHARS = 500_000
#: Largest table of shared anchors (one number each, some 50 MB in memory), in rows, that is broadcast.
BROADCAST_ANCHORS = 2_000_000


def least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive grams, the leftmost among equals."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.intp)
    place, span = np.arange(len(grams)), 1
    while span * 2 <= width:
        a, b = place[:-span], place[span:]
        place = np.where(grams[b] < grams[a], b, a)
        span *= 2
    a, b = place[:n], place[width - span : width - span + n]
    return np.where(grams[b] < grams[a], b, a)


def _runs(batches: Iterator[pa.RecordBatch], window: int, text: int = 1):
    """For each run of documents: their rows, first words, both halves of word digests, and which windows are of one document."""
    for batch in batches:
        for begin, end, buf, offsets in text_runs(batch.column(text)):
            starts, ends, first = word_spans(buf, offsets)
            words = word_digests(buf, starts, ends)
            yield batch.slice(begin, end - begin), first, words, within(first, window, len(words[0]))


def digest_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, version): doc_id, version and the 128-bit digest of the word sequence of each document that has a window."""
    for whole in batches:
        for batch in slabs(whole):
            keep, digests = [], []
            for k, raw in enumerate(batch.column(1).cast(pa.large_binary())):
                words = (raw.as_py() or b"").split()
                if len(words) >= window:
                    keep.append(k)
                    digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            kept = batch.take(pa.array(keep, pa.int64()))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), *[pa.array(halves[:, k].copy()) for k in (0, 1)]], ["doc_id", "version", "d1", "d2"])


def _distinct_by_document(values: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each value in each document, in order of documents, and how many each has."""
    cuts = np.searchsorted(owner, np.arange(docs + 1))
    found = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b > a:
            found.append(a + np.sort(np.unique(values[a:b], return_index=True)[1]))
    places = np.concatenate(found) if found else np.empty(0, np.intp)
    return places, np.bincount(owner[places], minlength=docs) if len(places) else np.zeros(docs, np.int64)


def anchor_batches(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """doc_id and the anchors of each document, once each."""
    for rows, first, (words, _), ok in _runs(batches, window):
        grams = gram_hashes(words, anchor)
        places = np.unique(least_places(grams, window - anchor + 1)[ok])
        owner = np.searchsorted(first, places, "right") - 1
        once, _ = _distinct_by_document(grams[places], owner, rows.num_rows)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner[once])), pa.array(grams[places[once]].view(np.int64))], ["doc_id", "anchor"])


def window_batches(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text), and the anchors to look under if there is a third column: doc_id, anchor and both halves of the hashes of the windows under it; each window once in a document."""
    for rows, first, words, ok in _runs(batches, window):
        grams = gram_hashes(words[0], anchor)
        halves = [gram_hashes(half, window) for half in words]
        at = np.flatnonzero(ok)
        owner = np.searchsorted(first, at, "right") - 1
        once, _ = _distinct_by_document(halves[0][at], owner, rows.num_rows)
        at, owner = at[once], owner[once]
        place = least_places(grams, window - anchor + 1)[at]
        if rows.num_columns > 2:
            cuts = np.searchsorted(owner, np.arange(rows.num_rows + 1)).tolist()
            own = [np.isin(grams[place[a:b]], rows.column(2)[k].values.to_numpy().view(np.uint64)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            keep = np.concatenate([np.empty(0, bool), *own])
            at, owner, place = at[keep], owner[keep], place[keep]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        offsets = pa.array(np.append(heads, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(half[at].view(np.int64))) for half in halves]
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner[heads])), pa.array(grams[place[heads]].view(np.int64)), *lists], ["doc_id", "anchor", "w1", "w2"])


def passage_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From (first, text, and w1, w2, repeaters of its recurring windows): the passages they make, each with its first window.

    A passage is a run of windows with the same repeaters; its words are joined by one space.
    """
    for batch in batches:
        table: list[tuple] = []
        for k in range(batch.num_rows):
            raw = batch.column(1)[k].cast(pa.large_binary()).as_py() or b""
            buf = np.frombuffer(raw, np.uint8)
            starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
            w1, w2 = (gram_hashes(half, window) for half in word_digests(buf, starts, ends))
            wanted = [batch.column(c)[k].values.to_numpy() for c in (2, 3, 4)]
            order = np.argsort(wanted[0].view(np.uint64))
            known, half, repeaters = (x[order] for x in wanted)
            place = np.minimum(np.searchsorted(known.view(np.uint64), w1), len(known) - 1)
            hit = (known.view(np.uint64)[place] == w1) & (half.view(np.uint64)[place] == w2)
            once = np.sort(np.unique(w1, return_index=True)[1])
            at = once[hit[once]]
            kind = repeaters[place[at]]
            words = raw.split()
            for run in np.split(at, np.flatnonzero((np.diff(at) != 1) | (kind[1:] != kind[:-1])) + 1):
                if len(run):
                    text = b" ".join(words[run[0] : run[-1] + window]).decode("utf-8", "surrogatepass")
                    table.append((batch.column(0)[k].as_py(), int(w1[run[0]].view(np.int64)), int(w2[run[0]].view(np.int64)), text))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in table], t) for c, t in enumerate(kinds)], ["first", "w1", "w2", "passage"])


class Located:
    """One document's words, and which of them are to go."""

    def __init__(self, raw: bytes, passages: list[str]):
        self.words = raw.split()
        self.gone = np.zeros(len(self.words) + 1, np.int32)  # +1 where a span begins, -1 where it ends
        self.passages = passages
        self.spans: list[tuple[int, int]] = []  # where passages stand: first word, words
        if passages:
            plain = [w.decode("utf-8", "surrogatepass") for w in self.words]
            self.text = " " + " ".join(plain) + " "
            self.starts = np.cumsum([1] + [len(w) + 1 for w in plain])[:-1]

    def drop(self, start: int, count: int) -> None:
        self.gone[start] += 1
        self.gone[start + count] -= 1

    def removed(self) -> np.ndarray:
        return np.cumsum(self.gone)[: len(self.words)] > 0


def _stream(docs: list[Located], wanted: list[list[str]]) -> list[set[str]]:
    """Compile the passages wanted, stream each document, drop what is meant for it, and return what each has not got."""
    automaton = ahocorasick.Automaton()
    for own in wanted:
        for p in own:
            automaton.add_word(f" {p} ", (p, p.count(" ") + 1))
    automaton.make_automaton()
    missing = []
    for doc, own in zip(docs, wanted):
        left, mine = set(own), set(own)
        if own:
            for end, (p, count) in automaton.iter(doc.text):
                if p in mine:
                    doc.spans.append((int(np.searchsorted(doc.starts, end - len(p))), count))
                    left.discard(p)
        missing.append(left)
    return missing


def locate(docs: list[Located], window: int) -> None:
    """All occurrences of each document's passages. A passage that does not stand whole in its document is sought by its windows."""
    shard: list[Located] = []
    chars = 0
    for doc in [*docs, None]:
        more = sum(map(len, doc.passages)) if doc else 0
        if shard and (doc is None or chars + more > SHARD_CHARS):
            missing = _stream(shard, [d.passages for d in shard])
            parts = [[" ".join(words[i : i + window]) for p in m if (words := p.split(" ")) for i in range(len(words) - window + 1)] for m in missing]
            if any(parts):
                _stream(shard, parts)
            shard, chars = [], 0
        if doc and doc.passages:
            shard.append(doc)
            chars += more


def finish_batches(batches: Iterator[pa.RecordBatch], window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, whole, version, passages): doc_id, n_words, n_removed, kept_sha256, version, and the remaining text if asked for (unchanged where nothing goes)."""
    for whole_batch in batches:
        for batch in slabs(whole_batch, 1, 2 << 20):
            raws = [r or b"" for r in batch.column(1).cast(pa.large_binary()).to_pylist()]
            passages = [p or [] for p in batch.column(4).to_pylist()] if batch.num_columns > 4 else [[]] * len(raws)
            docs = [Located(r, p) for r, p in zip(raws, passages)]
            locate(docs, window)
            nth = 0
            for _, first, (words, _), _ in _runs(iter([batch]), window):
                windows = gram_hashes(words, window)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    if b - a >= window:
                        own = windows[a : b - window + 1]
                        _, once, kind = np.unique(own, return_index=True, return_inverse=True)
                        told = np.zeros(len(once), bool)  # by kind of window: it stands in a passage that was located
                        for start, count in docs[nth].spans:
                            told[kind[start : start + count - window + 1]] = True
                        again = told[kind]
                        again[np.setdiff1d(np.arange(len(own)), once, assume_unique=True)] = True
                        for start in np.flatnonzero(again).tolist():
                            docs[nth].drop(start, window)
                    nth += 1
            rows = []
            for raw, doc, whole in zip(raws, docs, batch.column(2).to_pylist()):
                gone = np.ones(len(doc.words), bool) if whole else doc.removed()
                count = int(gone.sum())
                kept = b" ".join(w for w, g in zip(doc.words, gone.tolist()) if not g) if count else b" ".join(doc.words)
                rows.append((len(doc.words), count, hashlib.sha256(kept).hexdigest(), kept if count else raw))
            columns = [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]]
            columns.append(batch.column(3))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "version"]
            if keep_text:
                columns.append(pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Return doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) and version (a hash of the text) of each row, and the remaining text as ``kept`` if asked for."""
    # Rows of one id are told apart by a hash of their texts, their version.
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    named = docs.filter("doc_id is not null")

    digests = materialise(named.mapInArrow(lambda b: digest_batches(b, window), "doc_id bigint, version bigint, d1 bigint, d2 bigint"), "digests")
    least = digests.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("d1", "d2", "first")
    # Written tables on both sides, so that adaptive execution can split a group of very many copies.
    copies = digests.join(hinted(materialise(least, "firsts")), ["d1", "d2"]).filter("doc_id > first")
    copies = hinted(materialise(copies.select(F.col("doc_id").alias("__copy"), F.col("version").alias("__version")).distinct(), "copies"))
    is_copy = (F.col("doc_id") == F.col("__copy")) & (F.col("version") == F.col("__version"))
    distinct = named.join(copies, is_copy, "left_anti").select("doc_id", "text")

    anchored = distinct.mapInArrow(lambda b: anchor_batches(b, window, anchor), "doc_id bigint, anchor bigint")
    shared = materialise(anchored.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    under = lambda frame: frame.mapInArrow(lambda b: window_batches(b, window, anchor), "doc_id bigint, anchor bigint, w1 array<bigint>, w2 array<bigint>")
    if small(shared, broadcast_anchors):
        windows = under(distinct).join(F.broadcast(shared), "anchor", "left_semi")
    else:  # lists of windows are many times the text: let each document's shared anchors meet its text first
        own = anchored.join(shared, "anchor", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("anchor").alias("anchors"))
        windows = under(distinct.join(own, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "anchors"))
    windows = materialise(windows.select("doc_id", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("doc_id", "w.w1", "w.w2"), "windows")
    # Sums of two halves of hashes, which cannot overflow, stand for the set of documents that hold a window.
    half = lambda shift: F.sum(F.shiftrightunsigned(F.xxhash64("doc_id"), shift).bitwiseAND(0x7FFFFFFF))
    places = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), half(0).alias("s0"), half(32).alias("s1"))
    recurring = places.filter("first < last").select("first", "w1", "w2", F.xxhash64("s0", "s1").alias("repeaters"))
    cuts = materialise(recurring.groupBy("first").agg(*[F.collect_list(c).alias(c) for c in ("w1", "w2", "repeaters")]), "recurring")

    sources = hinted(materialise(cuts.select(F.col("first").alias("__first")), "sources"))
    texts = distinct.join(sources, F.col("doc_id") == F.col("__first"), "left_semi").select(F.col("doc_id").alias("first"), "text")
    passages = texts.join(cuts, "first").mapInArrow(lambda b: passage_batches(b, window), "first bigint, w1 bigint, w2 bigint, passage string")
    passages = materialise(passages, "passages")
    sent = materialise(windows.join(passages, ["w1", "w2"]).filter("doc_id > first").select(F.col("doc_id").alias("__id"), "passage"), "sent")
    sent = materialise(sent.groupBy("__id").agg(F.collect_set("passage").alias("passages")), "repeats")

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, version bigint" + ", kept string" * keep_text
    finish = lambda frame: frame.mapInArrow(lambda b: finish_batches(b, window, keep_text), schema)
    marked = hinted(sent.select("__id"))
    flagged = docs.join(copies, is_copy, "left").select("doc_id", "text", F.col("__copy").isNotNull().alias("whole"), "version")
    alone = flagged.join(marked, F.col("doc_id") == F.col("__id"), "left_anti")
    told = flagged.join(marked, F.col("doc_id") == F.col("__id"), "left_semi").join(sent, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "whole", "version", "passages")
    return finish(alone).unionByName(finish(told))
