"""Bootstraps of continuous values: each row draws its own Poisson(1) weight for every replicate, so replicates are sums over rows.

The weight follows from the row's identity and the number of the replicate alone. No group of rows comes to one task,
lost tasks draw the same weights again, and reruns agree but for the last digits of sums. Rows with the same identity
have the same weights: ``ids`` must tell rows apart. Null and non-finite values take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import distributions as D
from larkspur.operators.sums import by_key, keyed_sums

#: Shares of Poisson(1) up to each weight.
_UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
#: The weight of each of 65,536 ranges of draws, a byte each; 255 where a range holds more than one.
_BITS, _MIXED = 16, 255
_LEAST, _MOST = (np.searchsorted(_UPTO, ends, "right") for ends in (np.arange(1 << _BITS) / (1 << _BITS), np.arange(1, (1 << _BITS) + 1) / (1 << _BITS) - 2.0**-53))
_WEIGHTS = np.where(_LEAST == _MOST, _LEAST, _MIXED).astype(np.uint8)
#: Numbers that a kernel holds at once, so that they stay in a core's cache.
_BLOCK = 1 << 17
#: Rows that a task draws weights for at once.
_ROWS = 8000
#: Highest degree of the polynomials that stand for logistic curves.
_DEGREES = 160


def weight_blocks(identity: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, end row and weights (rows x replicates) of rows by their 64-bit identity in the replicates of those numbers, from 1 on; 0 stands for the rows as they are. The array is used again."""
    numbers = np.asarray(numbers, np.uint64)
    own, steps = identity.astype(np.int64).view(np.uint64), numbers * np.uint64(0x9E3779B97F4A7C15)
    rows = max(1, min(_BLOCK // max(len(numbers), 1), len(own)))
    held, shifted = (np.empty((rows, len(numbers)), np.uint64) for _ in range(2))
    marks = bytearray(held.size)
    small = np.frombuffer(marks, np.uint8).reshape(held.shape)
    asis = np.flatnonzero(numbers == 0)
    for at in range(0, len(own), rows):
        to = min(at + rows, len(own))
        z, t, k = held[: to - at], shifted[: to - at], small[: to - at]
        np.add(own[at:to, None], steps, out=z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.bitwise_xor(z, np.right_shift(z, np.uint64(shift), out=t), out=z)
            np.multiply(z, np.uint64(factor), out=z)
        np.right_shift(z, np.uint64(64 - _BITS), out=t)  # the last shift of the hash, by 31, leaves these bits as they are
        _WEIGHTS.take(t.view(np.int64), out=k, mode="wrap")
        w, between = t.view(float), []  # the shifted numbers are done with
        np.copyto(w, k)
        place = marks.find(_MIXED, 0, z.size)  # one in 8,000 is: a search for a byte is far faster than a comparison of all
        while place >= 0:
            between.append(place)
            place = marks.find(_MIXED, place + 1, z.size)
        if between:
            left = z.ravel()[between]
            w.ravel()[between] = np.searchsorted(_UPTO, ((left ^ (left >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right")
        w[:, asis] = 1.0
        yield at, to, w


def poisson_weights(identity: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of rows (by 64-bit identity) in replicates: rows x rounds."""
    out = np.empty((len(identity), rounds))
    for at, to, w in weight_blocks(identity, np.arange(1, rounds + 1)):
        out[at:to] = w
    return out


def weighted_sums(values: np.ndarray, identity: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Sums of values (quantities x rows) in replicates: quantities x replicates."""
    out = np.zeros((len(values), len(numbers)))
    for at, to, w in weight_blocks(identity, numbers):
        if len(values) > 3:
            out += values[:, at:to] @ w
        else:  # a few products with one vector each take half the time of one with a slim matrix
            for total, v in zip(out, values):
                total += v[at:to] @ w
    return out


def _rows(df: DataFrame, keys: list[str], ids: list[str], **columns: str) -> DataFrame:
    finite = df.select(*keys, *[F.col(c).cast("double").alias(name) for name, c in columns.items()], F.xxhash64(*ids).alias("_id"))
    for name in columns:
        finite = finite.filter(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf")))
    return finite


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: drawing weights takes far longer than moving a row, and a file may be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "_id")


def _totals(df: DataFrame, key: str, x: str, ids: list[str], rounds: int, strata: list[str]) -> DataFrame:
    """Per key an array of rows, total, and the total of each replicate, brought to the number of rows of each stratum.

    A replicate that draws no row of a stratum takes the stratum's mean for it.
    """

    def drawn(_, part: pd.DataFrame) -> np.ndarray:
        values = part["x"].to_numpy()
        return np.concatenate([[len(part), values.sum()], weighted_sums(np.stack([np.ones(len(part)), values]), part["_id"].to_numpy(), np.arange(1, rounds + 1)).ravel()])

    def scaled(_, part: pd.DataFrame) -> np.ndarray:
        out = np.zeros(2 + rounds)
        for sums in part["sums"]:
            n, total, w, wx = sums[0], sums[1], np.asarray(sums[2 : 2 + rounds]), np.asarray(sums[2 + rounds :])
            out += np.concatenate([[n, total], n * np.where(w > 0, wx / np.maximum(w, 1), total / n)])
        return out

    return keyed_sums(keyed_sums(_spread(_rows(df, [key, *strata], ids, x=x)), [key, *strata], drawn, _ROWS), [key], scaled)


def mean_interval(df: DataFrame, key: str, x: str, ids: list[str], rounds: int, strata: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Mean of x per key with its percentile interval; with strata each is resampled by itself and keeps its size."""

    def make(frames):
        for f in frames:
            out = []
            for name, sums in zip(f[key], f["sums"]):
                n, total, drawn = sums[0], sums[1], np.asarray(sums[2:])
                out.append((name, int(n), total / n, *np.quantile(drawn / n, [(1 - level) / 2, (1 + level) / 2])))
            yield pd.DataFrame(out, columns=[key, "n", "mean", "low", "high"])

    kind = df.schema[key].dataType.simpleString()
    return _totals(df, key, x, ids, rounds, strata or []).mapInPandas(make, f"`{key}` {kind}, n bigint, mean double, low double, high double")


def bca_interval(df: DataFrame, key: str, x: str, ids: list[str], rounds: int, level: float = 0.95) -> DataFrame:
    """Mean of x per key with its bias-corrected and accelerated interval.

    The jackknife of a mean needs no draws: its acceleration is the skewness of the rows over six roots of their number.
    """

    def make(frames):
        for f in frames:
            out = []
            for name, sums, skew in zip(f[key], f["sums"], f["skew"]):
                n, mean, drawn = sums[0], sums[1] / sums[0], np.asarray(sums[2:]) / sums[0]
                if n < 2 or drawn.std() <= 1e-12 * abs(mean):
                    out.append((name, int(n), mean, mean, mean))
                    continue
                below = np.clip(((drawn < mean).sum() + 0.5 * (drawn == mean).sum()) / rounds, 0.5 / rounds, 1 - 0.5 / rounds)
                z0, lean = float(D.normal_quantile(below)), 0.0 if pd.isna(skew) else skew / (6 * math.sqrt(n))
                z = z0 + D.normal_quantile(np.array([(1 - level) / 2, (1 + level) / 2]))
                out.append((name, int(n), mean, *np.quantile(drawn, D.normal_cdf(z0 + z / (1 - lean * z)))))
            yield pd.DataFrame(out, columns=[key, "n", "mean", "low", "high"])

    kind = df.schema[key].dataType.simpleString()
    skew = _rows(df, [key], ids, x=x).groupBy(F.col(key).alias("_of")).agg(F.skewness("x").alias("skew"))
    both = _totals(df, key, x, ids, rounds, []).join(skew, F.col(key).eqNullSafe(F.col("_of"))).select(key, "sums", "skew")
    return both.mapInPandas(make, f"`{key}` {kind}, n bigint, mean double, low double, high double")


def _polynomials(u: np.ndarray, degree: int) -> np.ndarray:
    """Chebyshev polynomials up to a degree (rows) at u (columns)."""
    out = np.ones((degree + 1, len(u)))
    if degree:
        out[1] = u
    for d in range(2, degree + 1):
        out[d] = 2 * u * out[d - 1] - out[d - 2]
    return out


def _powers(part: pd.DataFrame, place: tuple[float, float, float, float], degree: int) -> np.ndarray:
    """What a logistic fit needs of rows: polynomials of x over its range, y, and y times the scaled x."""
    m, s, centre, reach = place
    x, y = part["x"].to_numpy(), part["y"].to_numpy()
    return np.vstack([_polynomials(np.clip((x - centre) / reach, -1, 1), degree), y, y * ((x - m) / s)])


def _newton_move(g0, g1, h0, h1, h2) -> np.ndarray:
    h0, h2 = h0 + 1e-10, h2 + 1e-10
    det = h0 * h2 - h1**2
    return np.array([h2 * g0 - h1 * g1, h0 * g1 - h1 * g0]) / np.where(det > 0, det, 1.0)


def _fits_of_sums(sums: np.ndarray, place: tuple[float, float, float, float], degree: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic fits (2 x replicates, of the scaled x) to summed ``_powers`` (quantities x replicates); which of them are those of the rows, to 12 digits of the curve; and deviations of their slopes.

    A polynomial through degree + 1 places stands for the curve, so the sum of a curve over rows is a sum of its values at
    these places with the rows' weights there. That holds where the last terms of the curve vanish, which is tested.
    """
    m, s, centre, reach = place
    u = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    cardinal = 2 / (degree + 1) * _polynomials(u, degree).T
    cardinal[:, 0] /= 2
    weights, wy0, wy1, z = cardinal @ sums[: degree + 1], sums[-2], sums[-1], (centre + reach * u - m) / s
    b = np.zeros((2, sums.shape[1]))
    with np.errstate(all="ignore"):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(b[0] + z[:, None] * b[1], -30, 30)))
            bend = weights * p * (1 - p)
            h0, h1, h2 = bend.sum(0), z @ bend, z**2 @ bend
            move = _newton_move(wy0 - (weights * p).sum(0), wy1 - z @ (weights * p), h0, h1, h2)
            b = b + np.clip(move, -5, 5)
            if not (np.abs(move) >= 1e-8).any():
                break
        eta = b[0] + z[:, None] * b[1]
        rest = np.abs(cardinal.T @ (1 / (1 + np.exp(-eta))))[-2:].max(0) if degree else 0.0
        sure = (np.abs(move).max(0) < 1e-8) & (np.abs(eta).max(0) < 20) & (rest < 1e-12)
        return b, sure, np.sqrt(h0 / (h0 * h2 - h1**2))


def _fits_of_rows(rows: DataFrame, key: str, scale: dict, rounds: dict[object, np.ndarray], steps: int) -> dict:
    """Newton steps with one pass over the rows each: key to (coefficients, converged) of the numbered replicates of each key."""
    b = {k: np.zeros((2, len(numbers))) for k, numbers in rounds.items()}
    done = {k: False for k in rounds}
    for _ in range(steps):
        at = {k: b[k] for k in b if not done[k]}
        if not at:
            break

        def sums(name: tuple, part: pd.DataFrame, at=at) -> np.ndarray:
            if name[0] not in at:
                return np.zeros(1)
            m, s = scale[name[0]]
            z, y, (b0, b1) = (part["x"].to_numpy() - m) / s, part["y"].to_numpy(), at[name[0]]
            out = np.zeros((5, len(b0)))
            for first, end, w in weight_blocks(part["_id"].to_numpy(), rounds[name[0]]):
                here = z[first:end]
                p = 1 / (1 + np.exp(-np.clip(b0 + here[:, None] * b1, -30, 30)))
                rest, bend = w * (y[first:end, None] - p), w * p * (1 - p)
                out += [rest.sum(0), here @ rest, bend.sum(0), here @ bend, here**2 @ bend]
            return out.ravel()

        found = by_key(keyed_sums(rows, [key], sums), key)
        for k in at:
            move = _newton_move(*np.asarray(found[k]["sums"]).reshape(5, -1))
            b[k] = b[k] + np.clip(move, -5, 5)
            done[k] = bool(np.abs(move).max() < 1e-8)
    return {k: (b[k], done[k]) for k in b}


def logistic_replicates(df: DataFrame, key: str, x: str, y: str, ids: list[str], rounds: int, steps: int = 40) -> dict:
    """Logistic fits of y (0 or 1) on x per key: key to (coefficients, converged), an array of rounds + 1 intercepts and slopes, of which the first is the fit to all rows.

    A curve over the range of x is a polynomial to 12 digits, of a degree that follows from the fit to all rows. So one pass
    draws every row's weights and sums polynomials of x by replicate, and all Newton steps of a key's replicates work on
    these sums, in a task. Fits for which no polynomial suffices, such as those of separated rows, take a pass a step.
    """
    rows = _spread(_rows(df, [key], ids, x=x, y=y))
    seen = by_key(rows.groupBy(key).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("least"), F.max("x").alias("most")), key)
    scale = {k: (r.m, r.s or 1.0) for k, r in seen.items()}
    place = {k: (*scale[k], r.least / 2 + r.most / 2, r.most / 2 - r.least / 2 or 1.0) for k, r in seen.items()}
    numbers = np.arange(rounds + 1)
    flat = {k for k, r in seen.items() if r.least == r.most}
    degree = {}
    whole = by_key(keyed_sums(rows, [key], lambda name, part: _powers(part, place[name[0]], 0 if name[0] in flat else _DEGREES).sum(1)), key)
    for k, r in whole.items():
        b, sure, error = _fits_of_sums(np.asarray(r["sums"])[:, None], place[k], 0 if k in flat else _DEGREES, steps)
        if sure[0] and k in flat:
            degree[k] = 0
        elif sure[0] and np.isfinite(error[0]):
            # The curve's poles lie pi / steepness beside the range; replicates may be steeper by eight deviations.
            far = math.pi / max(place[k][3] / place[k][1] * (abs(b[1, 0]) + 8 * error[0]), 1e-3)
            degree[k] = max(8, math.ceil(14 * math.log(10) / math.asinh(far)) + 3)
    degree = {k: d for k, d in degree.items() if d <= _DEGREES}

    def drawn(name: tuple, part: pd.DataFrame) -> np.ndarray:
        if name[0] not in degree:
            return np.zeros(1)
        return weighted_sums(_powers(part, place[name[0]], degree[name[0]]), part["_id"].to_numpy(), numbers).ravel()

    def solve(frames):
        for f in frames:
            out = []
            for name, sums in zip(f[key], f["sums"]):
                k = None if pd.isna(name) else name
                if k in degree:
                    b, sure, _ = _fits_of_sums(np.asarray(sums).reshape(-1, rounds + 1), place[k], degree[k], steps)
                    out.append((name, b.ravel().tolist(), sure.tolist()))
            yield pd.DataFrame(out, columns=[key, "b", "sure"])

    kind = df.schema[key].dataType.simpleString()
    fits = by_key(keyed_sums(rows, [key], drawn).mapInPandas(solve, f"`{key}` {kind}, b array<double>, sure array<boolean>"), key) if degree else {}
    fits = {k: (np.reshape(r["b"], (2, rounds + 1)), np.array(r["sure"])) for k, r in fits.items()}
    open_ = {k: numbers[~fits[k][1]] if k in fits else numbers for k in scale}
    again = _fits_of_rows(rows, key, scale, {k: n for k, n in open_.items() if len(n)}, steps)
    out = {}
    for k, (m, s) in scale.items():
        b = fits[k][0] if k in fits else np.zeros((2, rounds + 1))
        if k in again:
            b[:, open_[k]] = again[k][0]
        slope = b[1] / s
        out[k] = (np.array([b[0] - slope * m, slope]), k not in again or again[k][1])
    return out


def parameter_intervals(df: DataFrame, key: str, x: str, y: str, ids: list[str], rounds: int, level: float = 0.95) -> DataFrame:
    """Intercept and slope of the logistic fit of y on x per key with percentile intervals, and whether these leave out 0. For 2,000 keys at most."""
    out = []
    for k, (b, done) in logistic_replicates(df, key, x, y, ids, rounds).items():
        for name, draws in zip(("intercept", "slope"), b):
            low, high = np.quantile(draws[1:], [(1 - level) / 2, (1 + level) / 2])
            out.append((k, name, float(draws[0]), float(low), float(high), bool(low > 0 or high < 0), done))
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"`{key}` {kind}, parameter string, estimate double, low double, high double, significant boolean, converged boolean")
