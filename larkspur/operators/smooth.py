"""Penalised regression splines whose penalty is chosen from sums of products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.sums import by_key, keyed_sums, row_quantiles


def basis(u: np.ndarray, breaks: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-splines over breaks (ends included), a column each."""
    t = np.concatenate([[breaks[0]] * degree, breaks, [breaks[-1]] * degree])
    held = np.clip(np.searchsorted(breaks, u, "right") - 1, 0, len(breaks) - 2) + degree
    out = np.zeros((len(u), len(t) - 1))
    out[np.arange(len(u)), held] = 1.0
    for d in range(1, degree + 1):
        n = len(t) - 1 - d
        rise, fall = t[d : d + n] - t[:n], t[d + 1 : d + 1 + n] - t[1 : 1 + n]
        up = np.where(rise > 0, (u[:, None] - t[:n]) / np.where(rise > 0, rise, 1), 0)
        down = np.where(fall > 0, (t[d + 1 : d + 1 + n] - u[:, None]) / np.where(fall > 0, fall, 1), 0)
        out = up * out[:, :n] + down * out[:, 1 : n + 1]
    return out


def roughness(breaks: np.ndarray) -> np.ndarray:
    """Integral of the products of the second derivatives of cubic B-splines, exactly: these are sums of hat functions over the breaks."""
    t = np.concatenate([[breaks[0]] * 3, breaks, [breaks[-1]] * 3])
    slope = np.eye(len(t) - 4)
    for d in (3, 2):
        t_in = t[3 - d : len(t) - (3 - d)]
        gap = t_in[d + 1 : -1] - t_in[1 : -d - 1]
        slope = d * np.diff(slope, axis=0) / gap[:, None]
    h = np.diff(breaks)
    hats = np.diag(np.append(h, 0) + np.append(0, h)) / 3 + (np.diag(h, 1) + np.diag(h, -1)) / 6
    return slope.T @ hats @ slope


def solved(a: np.ndarray, r: np.ndarray, s: np.ndarray, strength: float) -> tuple[np.ndarray, float]:
    """Coefficients and effective degrees of freedom at a strength of the penalty."""
    inverse = np.linalg.pinv(a + strength * s, rcond=1e-13, hermitian=True)
    return inverse @ r, float(np.trace(inverse @ a))


def score(a, r, zz, n, s, strength, known_scale: bool) -> float:
    """Generalised cross-validation; where the scale is known to be 1, the unbiased risk."""
    b, edf = solved(a, r, s, strength)
    rest = max(zz - 2 * b @ r + b @ a @ b, 0.0)
    return rest / n + 2 * edf / n - 1 if known_scale else n * rest / max(n - edf, 1e-9) ** 2


def best_strength(a, r, zz, n, s, known_scale: bool) -> float:
    """The strength of least score: the best of a grid over sixteen powers of ten, and of ever finer ones about it."""
    unit = np.trace(a) / max(np.trace(s), 1e-300)
    at, reach = 0.0, 8.0
    while reach > 1e-4:
        grid = at + np.linspace(-reach, reach, 33)
        at = float(grid[np.argmin([score(a, r, zz, n, s, unit * 10.0**g, known_scale) for g in grid])])
        reach /= 8
    return unit * 10.0**at


def penalised_spline(df: DataFrame, key: str, x: str, y: str, binomial: bool = True, knots: int = 10, steps: int = 40, held_after: int = 12) -> dict:
    """Cubic spline of y on x per key with a penalty on its curvature: key to n, breaks (over x), coefficients, edf, strength, score, log likelihood or residual variance, and whether it converged.

    Inner knots are quantiles over rows, exact and the same at every size. A step is one pass over the rows that sums
    weighted products of the basis by key; penalty and coefficients both follow from these sums. Least squares (``binomial``
    false) need one step; a logistic fit repeats it on working responses, and holds the penalty after some steps so that
    it settles. Null and non-finite values take no part; for 2,000 keys at most.
    """
    rows = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    shares = [0.0, *[k / (knots + 1) for k in range(1, knots + 1)], 1.0]
    fits = {}
    for k, r in by_key(row_quantiles(rows, key, "x", shares), key).items():
        low, width = r["quantiles"][0], (r["quantiles"][-1] - r["quantiles"][0]) or 1.0
        breaks = np.unique(np.append((np.array(r["quantiles"]) - low) / width, [0.0, 1.0]))
        fits[k] = {"n": r["n"], "low": low, "width": width, "breaks": breaks, "b": np.zeros(len(breaks) + 2), "strength": 0.0, "edf": 0.0, "score": None, "fit": None, "converged": False}
    for step in range(steps if binomial else 1):
        at = {k: (f["low"], f["width"], f["breaks"], f["b"]) for k, f in fits.items() if not f["converged"]}
        if not at:
            break

        def sums(name: tuple, part: pd.DataFrame, at=at) -> np.ndarray:
            if name[0] not in at:
                return np.zeros(1)
            low, width, breaks, b = at[name[0]]
            y, design = part["y"].to_numpy(), basis((part["x"].to_numpy() - low) / width, breaks)
            w, z, fit = np.ones(len(y)), y, 0.0
            if binomial:
                eta = np.clip(design @ b, -20, 20)
                p = 1 / (1 + np.exp(-eta))
                w, fit = p * (1 - p), float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
                z = eta + (y - p) / w
            return np.concatenate([(design.T @ (design * w[:, None])).ravel(), design.T @ (w * z), [w @ z**2, fit]])

        found = by_key(keyed_sums(rows, [key], sums), key)
        for k in at:
            f, v = fits[k], np.asarray(found[k]["sums"])
            m, s = len(f["b"]), roughness(f["breaks"])
            a, r, zz = v[: m * m].reshape(m, m), v[m * m : m * m + m], v[-2]
            if step < held_after:
                f["strength"] = best_strength(a, r, zz, f["n"], s, binomial)
            b, f["edf"] = solved(a, r, s, f["strength"])
            f["score"] = score(a, r, zz, f["n"], s, f["strength"], binomial)
            f["fit"] = v[-1] if binomial else max(zz - 2 * b @ r + b @ a @ b, 0.0) / max(f["n"] - f["edf"], 1e-9)
            f["converged"] = not binomial or bool(np.abs(basis(np.linspace(0, 1, 65), f["breaks"]) @ (b - f["b"])).max() < 1e-6)
            f["b"] = b
    return fits


def table(df: DataFrame, key: str, fits: dict, binomial: bool = True, points: int = 11) -> DataFrame:
    """Fits as rows: n, edf, strength, score, log_likelihood (residual variance of least squares), converged, and the curve at even places over the range of x."""
    out = []
    for k, f in fits.items():
        eta = basis(np.linspace(0, 1, points), f["breaks"]) @ f["b"]
        curve = 1 / (1 + np.exp(-eta)) if binomial else eta
        out.append((k, int(f["n"]), float(f["edf"]), float(f["strength"]), float(f["score"]), float(f["fit"]), f["converged"], [float(c) for c in curve]))
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"`{key}` {kind}, n bigint, edf double, strength double, score double, {'log_likelihood' if binomial else 'variance'} double, converged boolean, curve array<double>")
