"""Logistic regression with crossed random intercepts.

Penalised quasi-likelihood: every step linearises the model at the present fit, sums
the weighted products of its terms over all rows, by pair of levels, and solves one
small weighted least-squares problem with a ridge of one over each factor's variance,
choosing the variances that make the linearised data most likely. Rows are first
summed to distinct values, and those to one row for each combination of levels, so
the driver sees products of as many numbers as there are terms and levels.
The log likelihood reported is the Laplace approximation at the fit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import distributions as D
from larkspur.sources.scratch import scratch

#: Levels of all factors together, of which the driver solves a dense system.
MOST_LEVELS = 2000
STEPS, CLOSE = 100, 1e-7


def _lookup(column: str, levels: list, values: np.ndarray) -> Column:
    """The number of a row's level; levels are few (MOST_LEVELS), so they are a literal map. Null is a level."""
    table = F.create_map(*[F.lit(x) for pair in zip(map(str, range(len(levels))), map(float, values)) for x in pair])
    place = F.create_map(*[F.lit(x) for k, level in enumerate(levels) if level is not None for x in (level, str(k))] or [F.lit(""), F.lit("")])
    null = str(levels.index(None)) if None in levels else None
    return F.element_at(table, F.coalesce(F.try_element_at(place, F.col(column).cast("string")), F.lit(null)))


class _Sums:
    """Products of the terms over all cells, as dense blocks: fixed terms first, then the levels of each factor."""

    def __init__(self, cells: DataFrame, terms: list[str], factors: list[str]):
        self.cells, self.terms, self.factors = cells, terms, factors
        self.levels = [sorted((r[0] for r in cells.select(F.col(f).cast("string")).distinct().limit(MOST_LEVELS + 1).collect()), key=lambda x: (x is None, x)) for f in factors]
        if sum(map(len, self.levels)) > MOST_LEVELS:
            raise ValueError(f"random intercepts of more than {MOST_LEVELS} levels")
        self.first = np.cumsum([len(terms), *map(len, self.levels)])

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def at(self, fit: np.ndarray):
        """A = T'WT, b = T'Wz, z'Wz and the log likelihood, where T holds all terms, W the weights and z the working response."""
        p = len(self.terms)
        eta = F.lit(0.0)
        for t, beta in zip(self.terms, fit[:p]):
            eta = eta + F.col(t) * float(beta)
        for f, levels, first in zip(self.factors, self.levels, self.first):
            eta = eta + _lookup(f, levels, fit[first : first + len(levels)])
        rate = 1 / (1 + F.exp(-F.greatest(F.least(F.col("eta"), F.lit(30.0)), F.lit(-30.0))))
        rows = self.cells.withColumn("eta", eta).withColumn("rate", rate)
        rows = rows.withColumn("w", F.greatest(F.col("n") * F.col("rate") * (1 - F.col("rate")), F.lit(1e-12)))
        rows = rows.withColumn("z", F.col("eta") + (F.col("hits") - F.col("n") * F.col("rate")) / F.col("w"))
        columns = [F.col(t) for t in self.terms] + [F.col("z")]
        products = [F.sum(F.col("w") * a * b).alias(f"s{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
        likelihood = F.sum(F.col("hits") * F.log("rate") + (F.col("n") - F.col("hits")) * F.log(1 - F.col("rate"))).alias("ll")
        found = rows.groupBy(*[F.col(f).cast("string").alias(f) for f in self.factors]).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * c).alias(f"w{i}") for i, c in enumerate(columns)], *products, likelihood).collect()
        a, b, zz, ll = np.zeros((self.size, self.size)), np.zeros(self.size), 0.0, 0.0
        for r in sorted(found, key=lambda r: str([r[f] for f in self.factors])):
            places = [first + levels.index(r[f]) for f, levels, first in zip(self.factors, self.levels, self.first)]
            for i in range(p):
                b[i] += r[f"s{i}_{p}"]
                for j in range(i, p):
                    a[i, j] += r[f"s{i}_{j}"]
                for q in places:
                    a[i, q] += r[f"w{i}"]
            for q in places:
                b[q] += r[f"w{p}"]
                for q2 in places:
                    if q <= q2:
                        a[q, q2] += r["w"]
            zz, ll = zz + r[f"s{p}_{p}"], ll + r["ll"]
        return np.triu(a) + np.triu(a, 1).T, b, zz, ll


def _ridge(first: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    out = np.zeros(first[-1])
    for k, s in enumerate(sigma):
        out[first[k] : first[k + 1]] = 1 / s**2
    return out


def _solve(a, b, first, sigma):
    """Solution of the penalised problem and minus twice the log likelihood of the linearised data, but for a constant."""
    p, ridge = first[0], _ridge(first, sigma)
    full = a + np.diag(ridge)
    fit = np.linalg.solve(full, b)
    value = -b @ fit + np.linalg.slogdet(full[p:, p:])[1] - np.log(ridge[p:]).sum()
    return fit, value


def _best_sigma(a, b, first, sigma: np.ndarray) -> np.ndarray:
    """Variances of the linearised problem: each in turn by golden section on its logarithm, until none moves."""
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(100):
        before = sigma.copy()
        for k in range(len(sigma)):

            def value(log, k=k):
                now = sigma.copy()
                now[k] = math.exp(log)
                return _solve(a, b, first, now)[1]

            low, high = math.log(1e-4), math.log(20.0)
            x, y = high - ratio * (high - low), low + ratio * (high - low)
            fx, fy = value(x), value(y)
            while high - low > 1e-9:
                if fx < fy:
                    high, y, fy = y, x, fx
                    x = high - ratio * (high - low)
                    fx = value(x)
                else:
                    low, x, fx = x, y, fy
                    y = low + ratio * (high - low)
                    fy = value(y)
            sigma[k] = math.exp((low + high) / 2)
        if np.abs(np.log(sigma / before)).max() < 1e-8:
            break
    return sigma


def random_intercepts(df: DataFrame, y: str, terms: list[str], factors: list[str]) -> dict:
    """Fit of y (0 or 1) on the terms, with an intercept of its own, normal around 0, for each level of each factor.

    Rows with a null in y or a term are left out; null is a level of a factor. Returns estimates and standard errors by
    term, deviation by factor, intercepts by factor and level, the log likelihood, that without random intercepts, the
    likelihood ratio with its p (the null is on the edge: half of chi squared), aic, bic, rows and steps.
    """
    spark, names = df.sparkSession, ["intercept", *terms]
    columns = [F.lit(1.0).alias("intercept"), *[F.col(t).cast("double").alias(t) for t in terms]]
    known = df.filter(F.col(y).isNotNull()).dropna(subset=terms).select(*columns, *factors, F.col(y).cast("double").alias("_y"))
    path = scratch(spark, "cells")
    known.groupBy(*names, *factors).agg(F.sum("_y").alias("hits"), F.count(F.lit(1)).cast("double").alias("n")).write.parquet(path)
    cells = spark.read.parquet(path)
    total = cells.agg(F.sum("n"), F.sum("hits")).first()
    rows, hits = total[0] or 0, total[1] or 0
    if not rows or hits in (0, rows):
        raise ValueError("both outcomes must occur")
    sums = _Sums(cells, names, factors)
    p, first = len(names), sums.first
    plain = np.zeros(sums.size)
    plain[0] = math.log(hits / (rows - hits))
    for _ in range(STEPS):
        a, b, _, plain_ll = sums.at(plain)
        new = plain.copy()
        new[:p] = np.linalg.lstsq(a[:p, :p], b[:p], rcond=None)[0]
        moved, plain = np.abs(new - plain).max(), new
        if moved < CLOSE:
            break
    fit, sigma, step = plain, np.full(len(factors), 0.5), 0
    for step in range(1, STEPS + 1):
        a, b, _, _ = sums.at(fit)
        sigma = _best_sigma(a, b, first, sigma.copy())
        new, _ = _solve(a, b, first, sigma)
        moved, fit = np.abs(new - fit).max(), new
        if moved < CLOSE:
            break
    a, _, _, ll = sums.at(fit)
    ridge = _ridge(first, sigma)
    full = a + np.diag(ridge)
    laplace = ll - 0.5 * (ridge[p:] @ fit[p:] ** 2) - 0.5 * np.linalg.slogdet(full[p:, p:])[1] + 0.5 * np.log(ridge[p:]).sum()
    se = np.sqrt(np.diag(np.linalg.inv(full)))[:p]
    k = p + len(factors)
    ratio = max(0.0, 2 * (laplace - plain_ll))
    return {
        "estimates": dict(zip(names, fit[:p].tolist())),
        "errors": dict(zip(names, se.tolist())),
        "deviations": dict(zip(factors, sigma.tolist())),
        "intercepts": {f: dict(zip(levels, fit[s : s + len(levels)].tolist())) for f, levels, s in zip(factors, sums.levels, first)},
        "log_likelihood": float(laplace),
        "plain_log_likelihood": float(plain_ll),
        "ratio": ratio,
        "p": 0.5 * float(D.chi2_upper(ratio, len(factors))) if ratio > 0 else 1.0,
        "aic": 2 * k - 2 * laplace,
        "bic": k * math.log(rows) - 2 * laplace,
        "rows": int(rows),
        "steps": step,
    }


def table(spark, fit: dict) -> DataFrame:
    """A fit as rows: what (fixed, deviation, intercept or model), factor, term, estimate, se."""
    rows = [("fixed", None, t, e, fit["errors"][t]) for t, e in fit["estimates"].items()]
    rows += [("deviation", f, None, s, None) for f, s in fit["deviations"].items()]
    rows += [("intercept", f, level, e, None) for f, levels in fit["intercepts"].items() for level, e in levels.items()]
    rows += [("model", None, name, float(fit[name]), None) for name in ("log_likelihood", "plain_log_likelihood", "ratio", "p", "aic", "bic", "rows")]
    return spark.createDataFrame(rows, "what string, factor string, term string, estimate double, se double")
