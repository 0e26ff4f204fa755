"""Resampling and fitted models. Replicates are drawn with fixed seeds, so reruns agree; both run on aggregated counts."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_quantiles(x: np.ndarray, n: np.ndarray, q) -> np.ndarray:
    """Quantiles over rows of values that stand for n rows each: the least value that the share q of all rows does not exceed. The same at every scale of n."""
    order = np.argsort(x, kind="stable")
    share = np.cumsum(np.asarray(n, float)[order]) / np.sum(n)
    return np.asarray(x)[order][np.minimum(np.searchsorted(share, np.asarray(q) - 1e-12), len(x) - 1)]


def drawn_counts(rng: np.random.Generator, total: np.ndarray, take: int) -> np.ndarray:
    """How many rows of each kind are in a uniformly random set of ``take`` rows, for any number of rows.

    Each row is first in or out by itself; then as many random members leave, or others join, as there are too many or
    too few. Given its size the first set is uniform, and so is what remains. About the root of the number of rows are moved.
    """
    total = np.asarray(total, np.int64)
    rows = int(total.sum())
    if not 0 < take < rows:
        return total * (take >= rows)
    drawn = rng.binomial(total, take / rows)
    off = int(drawn.sum()) - take
    pool = drawn if off > 0 else total - drawn
    size, moved = int(pool.sum()), np.empty(0, np.int64)
    while len(moved) < abs(off):
        # Distinct rows of the pool, kept in the order in which they were drawn.
        moved = np.concatenate([moved, rng.integers(0, size, abs(off) - len(moved))])
        moved = moved[np.sort(np.unique(moved, return_index=True)[1])]
    counts = np.bincount(np.searchsorted(np.cumsum(pool), moved, "right"), minlength=len(total))
    return drawn - np.sign(off) * counts


def permutation_test(df: DataFrame, first: str, second: str, rounds: int) -> DataFrame:
    """Difference of means of two groups (columns g, x) and how often a relabelling that keeps their sizes is at least as far from zero.

    What a relabelling gives each distinct x is drawn from the counts of rows, exactly, at any number of rows.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = frame.pivot_table("n", "x", "g", "sum", fill_value=0, dropna=False).reindex(columns=[first, second], fill_value=0)
        x, own, other = counts.index.to_numpy(), counts[first].to_numpy().astype("int64"), counts[second].to_numpy().astype("int64")
        if not own.sum() or not other.sum():
            return pd.DataFrame({"observed": [None], "p": [None]}, dtype="float64")
        total, rng = own + other, np.random.default_rng(0)
        distance = lambda a: (a @ x) / a.sum(-1) - ((total - a) @ x) / (total - a).sum(-1)
        observed, extreme = distance(own), 0
        for _ in range(rounds):
            extreme += abs(distance(drawn_counts(rng, total, int(own.sum())))) >= abs(observed) - 1e-12
        return pd.DataFrame({"observed": [observed], "p": [(extreme + 1) / (rounds + 1)]})

    counted = df.filter(F.col("g").isin(first, second) & F.col("x").isNotNull()).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy().applyInPandas(run, "observed double, p double")


def bootstrap_mean(df: DataFrame, key: str, rounds: int) -> DataFrame:
    """Percentile interval of the mean of x per key. How often a replicate takes each distinct x is drawn from the counts of rows, so its cost does not grow with rows."""
    schema = f"{key} string, mean double, low double, high double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        name, x, n = frame[key].iloc[0], frame["x"].to_numpy(), frame["n"].to_numpy().astype("int64")
        rng = np.random.default_rng(zlib.crc32(str(name).encode()))
        m = np.array([rng.multinomial(n.sum(), n / n.sum()) @ x for _ in range(rounds)]) / n.sum()
        return pd.DataFrame([(name, m.mean(), *np.quantile(m, [0.025, 0.975]))], columns=[c.split()[0] for c in schema.split(", ")])

    counted = df.filter(F.col("x").isNotNull()).groupBy(key, "x").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).applyInPandas(lambda f: run(f.sort_values("x")), schema)


def _irls(x: np.ndarray, hits: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Logistic fit of grouped counts: coefficients, standard errors, log likelihood and whether it converged."""
    b, done = np.zeros(x.shape[1]), False
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        info = x.T @ (x * (n * p * (1 - p))[:, None]) + 1e-10 * np.eye(x.shape[1])
        move = np.linalg.solve(info, x.T @ (hits - n * p))
        b = b + move
        if np.abs(move).max() < 1e-8:
            done = True
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return b, np.sqrt(np.diag(np.linalg.inv(info))), float((hits * np.log(p) + (n - hits) * np.log(1 - p)).sum()), done


def _counts(df: DataFrame, key: str) -> DataFrame:
    """Distinct x with hits and rows: what a logistic fit needs, small whatever the number of rows."""
    return df.groupBy(key, "x").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))


def logistic_by_family(df: DataFrame, key: str) -> DataFrame:
    """Intercept, slope, standard errors, log likelihood, AIC and BIC of y on x per key."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(frame)), frame["x"]])
        b, se, ll, done = _irls(x, frame["hits"].to_numpy(), frame["n"].to_numpy())
        rows = frame["n"].sum()
        return pd.DataFrame([(frame[key].iloc[0], b[0], b[1], se[0], se[1], ll, 4 - 2 * ll, 2 * np.log(rows) - 2 * ll, bool(done))])

    schema = f"{key} string, intercept double, slope double, intercept_se double, slope_se double, log_likelihood double, aic double, bic double, converged boolean"
    return _counts(df, key).groupBy(key).applyInPandas(lambda f: fit(f).set_axis([c.split()[0] for c in schema.split(", ")], axis=1), schema)


def segmented_by_family(df: DataFrame, key: str, points: int = 20) -> DataFrame:
    """The breakpoint, of a grid over the middle 60 percent of x, whose two-slope logistic fit has the least AIC."""
    schema = f"{key} string, breakpoint double, aic double, linear_aic double"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, hits, n = frame["x"].to_numpy(), frame["hits"].to_numpy(), frame["n"].to_numpy()
        one = np.ones(len(x))
        best = (float("nan"), float("inf"))
        for at in np.linspace(*row_quantiles(x, n, [0.2, 0.8]), points):
            ll = _irls(np.column_stack([one, x, np.maximum(x - at, 0)]), hits, n)[2]
            if 8 - 2 * ll < best[1]:
                best = (float(at), 8 - 2 * ll)
        linear = 4 - 2 * _irls(np.column_stack([one, x]), hits, n)[2]
        return pd.DataFrame([(frame[key].iloc[0], *best, linear)], columns=[c.split()[0] for c in schema.split(", ")])

    return _counts(df, key).groupBy(key).applyInPandas(fit, schema)
