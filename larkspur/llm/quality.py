"""Quality by ridge regression on random Fourier features, calibrated isotonically.

Every document becomes a short vector of statistics of its bytes, words and
lines. Standardised by means and deviations over all documents, the vectors go
through random cosines that approximate a Gaussian kernel. Partitions of the
labelled rows sum their parts of the normal equations, one small solve gives the
ridge weights, and pool-adjacent-violators on rows kept aside turns raw scores
into probabilities.

Labels come only from rows whose crc32 of the id as text has remainder 0, 1 (for
the weights) or 3 (for the calibration) mod 4. At most about ``labelled`` rows,
chosen by hashes of ids, are used; statistics and scores cover every whole text.

Null and empty texts have the vector of an empty text; very long texts are read
whole, in batches cut by bytes; repeated rows and equal texts score alike, ties
included; without labels of both kinds every score is the share of label 1, or 0.5
without any; an empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, slabs
from larkspur.llm.toxicity import held_out, thinned

COSINES, RIDGE, LABELLED, SUMMING_TASKS = 256, 1e-3, 100_000, 16
#: Standardised statistics are kept within this many deviations.
CLIP = 4.0

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "white": [32, *range(9, 14)], "breaks": [10], "stops": [46, 44, 59, 58], "calls": [33, 63],
    "bars": [124], "signs": [35, 36, 37, 38, 42, 64, 94, 126, 43, 61, 60, 62, 95, 47, 92], "brackets": [40, 41, 91, 93, 123, 125], "wide": range(128, 256),
}
_MEMBERS = np.zeros((256, len(_GROUPS)))
for _k, _group in enumerate(_GROUPS.values()):
    _MEMBERS[list(_group), _k] = 1
STATISTICS = len(_GROUPS) + 7


def statistics(text: bytes) -> list[float]:
    """Shares of byte groups, and measures of words and lines."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBERS
    words, lines = text.split(), text.split(b"\n")
    w = len(words)
    letters = counts[0] + counts[1]
    return [
        *(counts / max(n, 1)).tolist(),
        counts[0] / max(letters, 1),
        math.log1p(w),
        math.log1p(n),
        len(set(words)) / max(w, 1),
        len(set(lines)) / len(lines),
        (n - counts[3]) / max(w, 1),
        counts[7] / max(w, 1),
    ]


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text, which tells rows of one id apart) and the statistics of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slabs(whole)):
            texts = batch.column(1).cast(pa.large_binary())
            flat = np.array([statistics(t or b"") for t in (x.as_py() for x in texts)], np.float32).ravel()
            offsets = np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "version", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version")).mapInArrow(run, f"doc_id {kind}, version bigint, x array<float>")


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing fit by pooling adjacent violators. Each pool counts half a row of either label beside its own."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of raw scores
    for r, y in zip(raw[order].tolist(), label[order].tolist()):
        pools.append([y, 1, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    values = np.array([(s + 0.5) / (n + 1) for s, n, _ in pools])
    return np.array([r / n for _, n, r in pools]), np.maximum.accumulate(values)


class Model:
    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.directions = rng.normal(size=(STATISTICS, COSINES)) / math.sqrt(STATISTICS)
        self.phases = rng.uniform(0, 2 * math.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.knots = self.values = None
        self.constant: float | None = None

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -CLIP, CLIP)
        return np.hstack([math.sqrt(2 / COSINES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.map(x) @ self.weights
        return np.clip(raw if self.knots is None else np.interp(raw, self.knots, self.values), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, STATISTICS)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """Fit on materialised vectors."""
    moments = stats.agg(*[f(F.get("x", F.lit(k)).cast("double")).alias(f"{n}{k}") for k in range(STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(STATISTICS)])
    deviation = np.array([moments[f"s{k}"] or 0.0 for k in range(STATISTICS)])
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1.0))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y")).filter(~held_out("__id") & F.col("y").isNotNull() & F.col("__id").isNotNull())
    count, share = known.agg(F.count(F.lit(1)), F.avg("y")).first()
    if not count or share in (0, 1):
        model.constant = 0.5 if not count else share
        return model
    rows = stats.join(thinned(known, "__id", count, labelled), F.col("doc_id") == F.col("__id"))
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3
    rows = materialise(rows.select("x", "y", aside.alias("aside")).repartition(SUMMING_TASKS), "labelled")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((COSINES + 1, COSINES + 1)), np.zeros(COSINES + 1)
        for batch in batches:
            z = model.map(_matrix(batch.column(0)))
            gram += z.T @ z
            right += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([gram, right]).tobytes()], pa.binary())], ["part"])

    parts = rows.filter("not aside").select("x", "y").mapInArrow(sums, "part binary").collect()  # one of fixed size for each summing task
    total = sum(np.frombuffer(p.part).reshape(-1, COSINES + 1) for p in parts)
    gram, right = total[:-1], total[-1]
    n = max(gram[-1, -1], 1.0)
    model.weights = np.linalg.solve(gram + RIDGE * n / COSINES * np.diag([1.0] * COSINES + [1e-6]), right)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.map(_matrix(batch.column(0))) @ model.weights), batch.column(1)], ["raw", "y"])

    kept = rows.filter("aside").select("x", "y").mapInArrow(raw, "raw double, y double").collect()  # a share of the bounded labelled rows
    pairs = np.array(sorted((r.raw, r.y) for r in kept)).reshape(-1, 2)
    if len(pairs):
        model.knots, model.values = isotonic(pairs[:, 0], pairs[:, 1])
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Return doc_id, held_out, score, predicted and version for every row of vectors."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(_matrix(batch.column(2))), pa.float64())], ["doc_id", "version", "score"])

    scored = stats.select("doc_id", "version", "x").mapInArrow(run, f"doc_id {kind}, version bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "version")
