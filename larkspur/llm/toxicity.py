"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, not
clean. Features are words and their heads and tails of a few letters; those much
more frequent in positives than in unlabelled text are kept, and a logistic
model is fitted with numpy on the non-negative estimate of the risk: with class
prior p, p R(positives as 1) + max(0, R(unlabelled as 0) - p R(positives as 0)),
and where the last bracket goes negative the step is taken to undo that. The
logistic loss makes scores probabilities.

Labels come only from rows whose crc32 of the id as text has not remainder 2 mod
4; the class prior is the share of toxic rows among them. Training takes at most
``positives`` labelled toxic rows, and the risk is estimated on about ``unlabelled``
rows of text, both chosen by hashes of ids. How frequent features are in unlabelled
text, and by that the prior, is counted over every text outside the held-out rows;
scoring takes every whole text.

Null and empty texts have no features and score by the bias alone; very long texts
are read whole, in batches cut by bytes; repeated rows and equal texts score alike,
ties included; without positives every score is 0; an empty table gives an empty
result. Repeated, null or unknown labels are harmless. Only named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, gram_hashes, materialise, mix, slabs, text_runs, word_hashes, word_spans

WORD = re.compile(r"\w+")
HEADS, TAILS = (4, 5, 6), (4, 5)
#: Bounds of training: rows of each kind, and features.
POSITIVES, UNLABELLED, FEATURES = 6_000, 12_000, 512
#: A feature is kept if so many positives have it, and if their number would be this unlikely (in nats) at the rate of unlabelled text.
LEAST_DOCUMENTS, LEAST_EVIDENCE = 5, 12.0
CACHED_WORDS = 300_000


def held_out(id_column) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def thinned(df: DataFrame, id_column: str, rows: int, most: int) -> DataFrame:
    """About ``most`` of ``rows`` rows, by a hash of the id; all if there are no more."""
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column)), F.lit(1 << 30)) < int((1 << 30) * most / rows))


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in HEADS if len(word) > k), *("~" + word[-k:] for k in TAILS if len(word) > k)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights, the bias last, of a logistic model by Adam on the non-negative risk. Inputs are 0/1 matrices."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1):
        at_p, at_u = p @ w, u @ w
        as_zero_p = p.T @ sigmoid(at_p) / len(p)  # gradient of the positives' risk as 0
        as_zero_u = u.T @ sigmoid(at_u) / len(u)
        as_one_p = -(p.T @ sigmoid(-at_p)) / len(p)
        rest = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        gradient = prior * as_one_p + as_zero_u - prior * as_zero_p if rest >= 0 else prior * as_zero_p - as_zero_u
        gradient[:-1] += decay * w[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def families(sample: DataFrame, slots: int = 4) -> DataFrame:
    """Drop near copies within each kind of row, so that one text's odd words do not pass for evidence: rows that share a least hash of word 3-grams, for any of a few hash functions, count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, _, buf, offsets in text_runs(batch.column(0)):
                starts, ends, first = word_spans(LOWER[buf], offsets)
                grams = gram_hashes(word_hashes(LOWER[buf], starts, ends), 3)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = grams[a : max(b - 2, a)]
                    keys.append([int(mix(own ^ np.uint64(k + 1)).min() >> np.uint64(1)) if len(own) else k for k in range(slots)])
            table = np.array(keys, np.int64).reshape(-1, slots)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(table[:, k].copy()) for k in range(slots)]], [*batch.schema.names, *[f"family{k}" for k in range(slots)]])

    keyed = sample.mapInArrow(run, sample.schema.simpleString()[7:-1].replace(":", " ") + "".join(f", family{k} bigint" for k in range(slots)))
    for k in range(slots):
        # the row to stay is the same in every run
        order = Window.partitionBy("positive", "drawn", f"family{k}").orderBy(*[f"family{j}" for j in range(slots)], "text")
        keyed = keyed.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return keyed.select(*sample.columns)


class Model:
    def __init__(self, features: list[str], weights: np.ndarray):
        self.place = {f: k for k, f in enumerate(features)}
        self.weights = weights
        self.cache: dict[str, tuple[int, ...]] = {}

    def places(self, text: str | None) -> set[int]:
        found: set[int] = set()
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, place = self.cache, self.place
        for w in set(WORD.findall((text or "").lower())):
            ids = cache.get(w)
            if ids is None:
                ids = cache[w] = tuple(place[f] for f in word_features(w) if f in place)
            if ids:
                found.update(ids)
        return found

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        at = sorted(self.places(text))
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.weights[-1], -50, 50))))


def _document_counts(sample: DataFrame, least: int) -> dict[str, int]:
    """In how many texts of a bounded sample each feature is, if in at least so many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                counter.update(text_features(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], ["feature", "n"])

    counted = sample.select("text").mapInArrow(count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    return {r.feature: r.n for r in counted.filter(F.col("n") >= least).collect()}


def _rates(texts: DataFrame, features: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all texts each of the given features is, and how many texts there are: one pass, one row of counts a task."""
    model, width = Model(features, np.zeros(len(features) + 1)), len(features)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width + 1, np.int64)
        for batch in (part for whole in batches for part in slabs(whole, 0)):
            counts[-1] += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts[list(model.places(text))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["at", "n"])

    counted = texts.select("text").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    found = {r.at: r.n for r in counted.collect()}  # a row a feature, of which bounded positives bound the number
    return {features[k]: n for k, n in found.items() if k < width}, found.get(width, 0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter(~held_out("__id") & F.col("__label").isNotNull() & F.col("__id").isNotNull())
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("__label").alias("p")).first()
    if not counts.p:
        return Model([], np.empty(0))
    prior = min(max(counts.p / counts.n, 1e-4), 0.9)
    chosen = thinned(known.filter("__label = 1").select("__id").distinct(), "__id", counts.p, positives)
    pool = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(~held_out("doc_id"))
    marked = pool.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"), "left").withColumn("positive", F.col("__id").isNotNull())
    share = min(1.0, unlabelled / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit("pool"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * share)
    sample = materialise(marked.withColumn("drawn", drawn).filter("positive or drawn").select("text", "positive", "drawn"), "sample")
    sample = materialise(families(sample), "sample")

    totals = sample.agg(F.count_if("positive").alias("p"), F.count_if("drawn").alias("u")).first()
    if not totals.p or not totals.u:
        return Model([], np.empty(0))
    in_positives = _document_counts(sample.filter("positive"), LEAST_DOCUMENTS)
    in_text, texts = _rates(pool, sorted(in_positives))
    evidence = {}
    for feature, p in in_positives.items():
        expected = totals.p * (in_text.get(feature, 0) + 0.5) / texts
        if p > expected and (e := p * np.log(p / expected) - p + expected) >= LEAST_EVIDENCE:
            evidence[feature] = e
    # Features that only positives have are as frequent in unlabelled text as the prior says; where labels claim more, believe the text.
    strong = sorted(evidence, key=evidence.get)[-50:]
    if strong:
        prior = min(prior, max(1e-4, (sum(in_text.get(f, 0) for f in strong) / texts) / (sum(in_positives[f] for f in strong) / totals.p)))
    names = sorted(evidence, key=lambda f: (-evidence[f], f))[:features]
    model = Model(names, np.zeros(len(names) + 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(model.places(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["at", "positive", "drawn"])

    rows = sample.mapInArrow(place, "at array<int>, positive boolean, drawn boolean").collect()
    rows.sort(key=lambda r: (r.positive, r.at))
    matrices = []
    for kind in ("positive", "drawn"):
        own = [r.at for r in rows if r[kind]]
        x = np.zeros((len(own), len(names)), np.float32)
        for k, at in enumerate(own):
            x[k, at] = 1
        matrices.append(x)
    model.weights = fit(*matrices, prior)
    model.cache = {}
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, held_out, score and predicted for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slabs(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
