"""Tests, intervals and fits that need numpy: each runs on moments or grouped counts, small whatever the number of rows."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import distributions as D
from larkspur.operators.models import _irls, row_quantiles


def _by_rows(df: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], added: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(lambda frames: (make(f) for f in frames if len(f)), f"{fields}, {added}")


def t_tests(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds p, the interval of the difference and the power to rows of operators.statistics.welch; degrees of freedom are n1 + n2 - 2, as the reference has them."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = f["n_a"].to_numpy(float), f["n_b"].to_numpy(float)
        df, se = n1 + n2 - 2, np.sqrt(f["var_a"] / n1 + f["var_b"] / n2)
        t = np.nan_to_num(f["t"].to_numpy(float))
        reach = D.t_quantile(1 - alpha / 2, df) * se
        power = [D.t_test_power(0.0 if d is None or math.isnan(d) else d, int(a), int(b), alpha) for d, a, b in zip(f["d"], n1, n2)]
        return f.assign(df=df, p=D.t_two_sided(t, df), t_low=f["difference"] - reach, t_high=f["difference"] + reach, power=power)

    return _by_rows(pairs, make, "df double, p double, t_low double, t_high double, power double")


def paired_tests(groups: DataFrame) -> DataFrame:
    """Adds the two-sided p of t with n - 1 degrees of freedom; a missing t counts as 0."""
    return _by_rows(groups, lambda f: f.assign(p=D.t_two_sided(f["t"].fillna(0.0), f["n"] - 1)), "p double")


def normal_p(rows: DataFrame) -> DataFrame:
    """Adds the two-sided p of z; a missing z counts as 0."""
    return _by_rows(rows, lambda f: f.assign(p=2 * (1 - D.normal_cdf(np.abs(f["z"].fillna(0.0).to_numpy(float))))), "p double")


def t_intervals(moments: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds the t-interval of the mean to rows with n, mean and var; a single value has 0 to 1."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        n = f["n"].to_numpy(float)
        reach = D.t_quantile((1 + level) / 2, np.maximum(n - 1, 1)) * np.sqrt(f["var"].fillna(0.0) / n)
        return f.assign(low=np.where(n > 1, f["mean"] - reach, 0.0), high=np.where(n > 1, f["mean"] + reach, 1.0))

    return _by_rows(moments, make, "low double, high double")


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(":".join(map(str, parts)).encode()))


def _per_key(counts: DataFrame, key: str, make: Callable[[object, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return counts.groupBy(key).applyInPandas(lambda f: pd.DataFrame(make(f[key].iloc[0], f.sort_values(list(f.columns))), columns=names), schema)


def stratified_bootstrap(df: DataFrame, key: str, strata: list[str], rounds: int) -> DataFrame:
    """Percentile interval of the mean of x per key, each stratum resampled by itself and keeping its size."""

    def make(name, f):
        rng, total = _seed("strata", name), np.zeros(rounds)
        for _, part in f.groupby(strata, sort=True, dropna=False):
            n = part["n"].to_numpy("int64")
            total += rng.multinomial(n.sum(), n / n.sum(), rounds) @ part["x"].to_numpy(float)
        mean = total / f["n"].sum()
        return [(name, float((f["n"] * f["x"]).sum() / f["n"].sum()), *np.quantile(mean, [0.025, 0.975]))]

    counts = df.filter(F.col("x").isNotNull()).groupBy(key, *strata, "x").agg(F.count(F.lit(1)).alias("n"))
    return _per_key(counts, key, make, f"{key} string, mean double, low double, high double")


def bca_interval(df: DataFrame, key: str, rounds: int, level: float = 0.95) -> DataFrame:
    """Bias-corrected and accelerated interval of the mean of x per key. The jackknife leaves out each distinct x once, weighted by its count, so it covers all rows."""

    def make(name, f):
        x, n = f["x"].to_numpy(float), f["n"].to_numpy("int64")
        total, rows = float(n @ x), int(n.sum())
        mean = total / rows
        drawn = _seed("bca", name).multinomial(rows, n / rows, rounds) @ x / rows
        if rows < 2 or drawn.std() == 0:
            return [(name, mean, mean, mean)]
        below = np.clip(((drawn < mean).sum() + 0.5 * (drawn == mean).sum()) / rounds, 0.5 / rounds, 1 - 0.5 / rounds)
        z0 = float(D.normal_quantile(below))
        left = (total - x) / (rows - 1)
        gap = (n @ left) / rows - left
        spread = float(n @ gap**2)
        lean = float(n @ gap**3) / (6 * spread**1.5) if spread > 0 else 0.0
        z = z0 + D.normal_quantile(np.array([(1 - level) / 2, (1 + level) / 2]))
        return [(name, mean, *np.quantile(drawn, D.normal_cdf(z0 + z / (1 - lean * z))))]

    counts = df.filter(F.col("x").isNotNull()).groupBy(key, "x").agg(F.count(F.lit(1)).alias("n"))
    return _per_key(counts, key, make, f"{key} string, mean double, low double, high double")


def _ranks(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Average ranks of values that stand for n rows each."""
    kinds, place = np.unique(values, return_inverse=True)
    size = np.bincount(place, weights=n, minlength=len(kinds))
    return (np.cumsum(size) - (size - 1) / 2)[place]


def _weighted_correlation(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    dx, dy = x - n @ x / n.sum(), y - n @ y / n.sum()
    scale = math.sqrt((n @ dx**2) * (n @ dy**2))
    return float(n @ (dx * dy) / scale) if scale else 0.0


def spearman_bootstrap(df: DataFrame, key: str, rounds: int, least: int = 10) -> DataFrame:
    """Spearman's correlation of x and y per key of at least so many rows, with its percentile interval."""

    def make(name, f):
        x, y, n = f["x"].to_numpy(float), f["y"].to_numpy(float), f["n"].to_numpy("int64")
        if n.sum() < least:
            return []
        rho = lambda m: _weighted_correlation(_ranks(x, m), _ranks(y, m), m)
        drawn = [rho(m) for m in _seed("rho", name).multinomial(n.sum(), n / n.sum(), rounds)]
        return [(name, int(n.sum()), rho(n), *np.quantile(drawn, [0.025, 0.975]))]

    counts = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return _per_key(counts, key, make, f"{key} string, n bigint, rho double, low double, high double")


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("y").alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))


def parameter_bootstrap(df: DataFrame, key: str, rounds: int) -> DataFrame:
    """Intercept and slope of a logistic fit of y on x per key, with percentile intervals and whether these leave out 0."""

    def make(name, f):
        x, hits, n = (f[c].to_numpy(float) for c in ("x", "hits", "n"))
        design, cells = np.column_stack([np.ones(len(x)), x]), np.concatenate([hits, n - hits])
        fitted = _irls(design, hits, n)[0]
        draws = _seed("parameters", name).multinomial(int(n.sum()), cells / cells.sum(), rounds).astype(float)
        found = np.array([_irls(design, d[: len(x)], d[: len(x)] + d[len(x) :])[0] for d in draws])
        low, high = np.quantile(found, [0.025, 0.975], axis=0)
        return [(name, p, float(fitted[k]), float(low[k]), float(high[k]), bool(low[k] > 0 or high[k] < 0)) for k, p in enumerate(("intercept", "slope"))]

    return _per_key(_counts(df, key, "x"), key, make, f"{key} string, parameter string, estimate double, low double, high double, significant boolean")


def interaction_fit(df: DataFrame, key: str) -> DataFrame:
    """Logistic fit of y on x, a condition (column c, 0 or 1) and their product per key: estimates, standard errors, z, p."""

    def make(name, f):
        x, c = f["x"].to_numpy(float), f["c"].to_numpy(float)
        b, se, _, _ = _irls(np.column_stack([np.ones(len(x)), x, c, x * c]), f["hits"].to_numpy(float), f["n"].to_numpy(float))
        z = b / se
        return [(name, term, float(b[k]), float(se[k]), float(z[k]), float(2 * (1 - D.normal_cdf(abs(z[k]))))) for k, term in enumerate(("intercept", "x", "condition", "x:condition"))]

    return _per_key(_counts(df, key, "x", "c"), key, make, f"{key} string, term string, estimate double, se double, z double, p double")


def spline_basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Intercept and cubic B-splines without the first, over inner knots; together they span all cubic splines."""
    low, high = x.min(), x.max()
    t = np.concatenate([[low] * 4, knots, [high] * 4]).astype(float)
    basis = np.array([(x >= a) & ((x < b) | ((b == high) & (x == high) & (a < b))) for a, b in zip(t[:-1], t[1:])], float)
    for d in range(1, 4):
        rows = []
        for k in range(len(basis) - 1):
            left, right = t[k + d] - t[k], t[k + d + 1] - t[k + 1]
            rows.append((basis[k] * (x - t[k]) / left if left else 0) + (basis[k + 1] * (t[k + d + 1] - x) / right if right else 0) + 0 * x)
        basis = np.array(rows)
    return np.column_stack([np.ones(len(x)), basis[1:].T])


def family_models(df: DataFrame, key: str, least: int = 50, knots: int = 5, points: int = 20) -> DataFrame:
    """Linear, segmented and spline logistic fits of y on x per key of at least so many rows: likelihood, criteria, likelihood ratio against the linear fit, and which has the least AIC."""

    def make(name, f):
        x, hits, n = (f[c].to_numpy(float) for c in ("x", "hits", "n"))
        rows, one = n.sum(), np.ones(len(f))
        if rows < least:
            return []
        line = np.column_stack([one, x])
        breaks = np.linspace(*row_quantiles(x, n, [0.2, 0.8]), points)
        bent = max(_irls(np.column_stack([line, np.maximum(x - at, 0)]), hits, n)[2] for at in breaks)
        inner = np.unique(row_quantiles(x, n, np.linspace(0, 1, knots + 2)[1:-1]))
        inner = inner[(inner > x.min()) & (inner < x.max())]
        curve = spline_basis(x, inner)
        fits = [("linear", 2, _irls(line, hits, n)[2]), ("segmented", 4, bent), ("spline", curve.shape[1], _irls(curve, hits, n)[2])]
        best = min(fits, key=lambda m: 2 * m[1] - 2 * m[2])[0]
        base = fits[0]
        out = []
        for model, k, ll in fits:
            ratio = max(0.0, 2 * (ll - base[2]))
            p = float(D.chi2_upper(ratio, k - base[1])) if k > base[1] else None
            out.append((name, model, k, float(ll), 2 * k - 2 * ll, k * math.log(rows) - 2 * ll, ratio if p is not None else None, p, model == best))
        return out

    return _per_key(_counts(df, key, "x"), key, make, f"{key} string, model string, parameters int, log_likelihood double, aic double, bic double, ratio double, p double, chosen boolean")


def contamination_fit(df: DataFrame, y: str, terms: list[str]) -> DataFrame:
    """Least squares of y on the terms over all rows, from one row of products: estimate and standard error of each term, R2 and rows."""
    columns = [F.lit(1.0), *[F.col(t).cast("double") for t in terms], F.col(y).cast("double")]
    m = len(columns)
    names = ["intercept", *terms]
    sums = df.dropna(subset=[y, *terms]).agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)])

    def make(f: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                s[i, j] = s[j, i] = f[f"s{i}_{j}"].iloc[0] or 0.0
        gram, right, n = s[:-1, :-1], s[:-1, -1], s[0, 0]
        inverse = np.linalg.pinv(gram)
        b = inverse @ right
        rest = s[-1, -1] - b @ right
        spread = s[-1, -1] - s[0, -1] ** 2 / n if n else 0.0
        se = np.sqrt(np.maximum(np.diag(inverse), 0) * max(rest, 0) / max(n - len(b), 1))
        return pd.DataFrame({"term": names, "estimate": b, "se": se, "r2": 1 - rest / spread if spread > 0 else 0.0, "n": int(n)})

    return sums.mapInPandas(lambda frames: (make(f) for f in frames if len(f)), "term string, estimate double, se double, r2 double, n bigint")


def polynomial_fits(df: DataFrame, key: str, x: str, y: str, degrees: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Least-squares polynomials of y on x per key: coefficients from the constant up, R2 and half the 95 percent band of residuals.

    From power sums of x less its mean over the scale of its deviation, so that they stay well conditioned.
    """
    most = max(degrees)
    base = df.dropna(subset=[x, y]).groupBy(key).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = (F.col(x) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    scaled = df.dropna(subset=[x, y]).join(base, key).withColumn("_z", z)
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(F.col("_z"), F.lit(float(k)))
    sums = scaled.groupBy(key, "_m", "_s").agg(*[F.sum(power(k)).alias(f"x{k}") for k in range(2 * most + 1)], *[F.sum(power(k) * F.col(y)).alias(f"y{k}") for k in range(most + 1)], F.sum(F.col(y) * F.col(y)).alias("yy"))

    def make(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                for d in degrees:
                    gram = np.array([[r[f"x{i + j}"] for j in range(d + 1)] for i in range(d + 1)])
                    right = np.array([r[f"y{i}"] for i in range(d + 1)])
                    b = np.linalg.lstsq(gram, right, rcond=None)[0]
                    rest = max(r["yy"] - b @ right, 0.0)
                    spread = r["yy"] - r["y0"] ** 2 / r["x0"]
                    line = np.polynomial.Polynomial(b)(np.polynomial.Polynomial([-r["_m"] / (r["_s"] or 1.0), 1 / (r["_s"] or 1.0)]))
                    out.append((r[key], d, np.resize(line.coef, d + 1).tolist(), 1 - rest / spread if spread > 0 else 0.0, 1.96 * math.sqrt(rest / r["x0"])))
            yield pd.DataFrame(out, columns=[key, "degree", "coefficients", "r2", "band"])

    return sums.mapInPandas(make, f"{key} string, degree int, coefficients array<double>, r2 double, band double")
