"""Random intercepts against a direct maximiser; draws and quantiles of counts at every scale."""

import numpy as np
import pandas as pd
import pytest

from larkspur.operators import inference as I
from larkspur.operators import mixed
from larkspur.operators import models as M


def data(n=6000, seed=0):
    rng = np.random.default_rng(seed)
    d, f, x, c = rng.integers(0, 9, n), rng.integers(0, 5, n), rng.choice([-1.0, 0.0, 0.5, 2.0], n), rng.integers(0, 2, n).astype(float)
    u, w = rng.normal(0, 0.9, 9), rng.normal(0, 0.5, 5)
    eta = -0.3 + 0.6 * x - 0.8 * c + u[d] + w[f]
    return pd.DataFrame({"y": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int), "x": x, "c": c, "d": [None if k == 8 else f"d{k}" for k in d], "f": f})


def laplace(theta, X, Z, hits, n):
    """Log marginal likelihood by Laplace's method, on dense matrices: the mode of the intercepts by Newton's method."""
    beta, sigma = theta[:3], np.exp(theta[3:])
    precision = np.concatenate([np.full(9, 1 / sigma[0] ** 2), np.full(5, 1 / sigma[1] ** 2)])
    u = np.zeros(14)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(X @ beta + Z @ u)))
        hessian = Z.T @ (Z * (n * p * (1 - p))[:, None]) + np.diag(precision)
        move = np.linalg.solve(hessian, Z.T @ (hits - n * p) - precision * u)
        u += move
        if np.abs(move).max() < 1e-11:
            break
    p = 1 / (1 + np.exp(-(X @ beta + Z @ u)))
    hessian = Z.T @ (Z * (n * p * (1 - p))[:, None]) + np.diag(precision)
    return (hits * np.log(p) + (n - hits) * np.log(1 - p)).sum() - 0.5 * precision @ u**2 + 0.5 * np.log(precision).sum() - 0.5 * np.linalg.slogdet(hessian)[1]


def climb(value, at):
    """Coordinate and pattern search, slow and plain."""
    at, step = np.array(at), np.full(len(at), 0.2)
    best = value(at)
    while step.max() > 1e-5:
        for k in range(len(at)):
            for sign in (1, -1):
                there = at.copy()
                there[k] += sign * step[k]
                if (v := value(there)) > best:
                    at, best = there, v
                    step[k] *= 1.6
                    break
            else:
                step[k] /= 2
    return at, best


def test_random_intercepts_against_a_direct_maximiser(spark):
    rows = data()
    fit = mixed.random_intercepts(spark.createDataFrame(rows).repartition(5), "y", ["x", "c"], ["d", "f"])
    cells = rows.assign(d=rows.d.fillna("d8"), n=1).groupby(["x", "c", "d", "f"], as_index=False).agg(hits=("y", "sum"), n=("n", "sum"))
    X = np.column_stack([np.ones(len(cells)), cells.x, cells.c])
    Z = np.column_stack([*[(cells.d == f"d{k}") for k in range(9)], *[(cells.f == k) for k in range(5)]]).astype(float)
    args = X, Z, cells.hits.to_numpy(float), cells.n.to_numpy(float)
    own = [*fit["estimates"].values(), *np.log([*fit["deviations"].values()])]
    assert abs(laplace(np.array(own), *args) - fit["log_likelihood"]) < 1e-6
    top, best = climb(lambda t: laplace(t, *args), own)
    assert best - fit["log_likelihood"] < 0.02
    assert np.abs(top[:3] - own[:3]).max() < 0.02 and np.abs(np.exp(top[3:]) - np.exp(own[3:])).max() < 0.03
    assert fit["ratio"] > 100 and fit["p"] < 1e-6 and fit["rows"] == 6000 and None in fit["intercepts"]["d"]
    assert abs(fit["aic"] - (10 - 2 * fit["log_likelihood"])) < 1e-9


def test_no_groups_to_find(spark):
    rows = data(3000, 1)
    rows["d"] = np.random.default_rng(5).integers(0, 9, 3000)
    rows["f"] = 1
    fit = mixed.random_intercepts(spark.createDataFrame(rows), "y", ["x"], ["d", "f"])
    assert fit["deviations"]["f"] < 0.3 and fit["ratio"] < 3 and fit["p"] > 0.05
    with pytest.raises(ValueError):
        mixed.random_intercepts(spark.createDataFrame(rows.assign(y=1)), "y", ["x"], ["d"])


def test_fits_are_the_same_at_every_scale_of_counts(spark):
    rng = np.random.default_rng(3)
    x = np.arange(100) / 10
    n = rng.integers(50, 150, 100)
    hits = rng.binomial(n, 1 / (1 + np.exp(2 - 0.7 * np.minimum(x, 5) + 0.2 * np.sin(3 * x))))
    fits = []
    for scale in (1, 10, 1000, 100_000):
        frame = pd.DataFrame({"k": "a", "x": x, "hits": hits * float(scale), "n": n * float(scale)})
        knots = M.row_quantiles(frame.x.to_numpy(), frame.n.to_numpy(), np.linspace(0, 1, 7)[1:-1])
        ll = M._irls(I.spline_basis(x, np.unique(knots)), frame.hits.to_numpy(), frame.n.to_numpy())[2]
        fits.append((knots.tolist(), round(ll / scale, 5)))
    assert all(f == fits[0] for f in fits)
    assert M.row_quantiles(np.array([3.0, 1.0, 2.0]), np.array([1, 1, 2]), [0.25, 0.5, 0.75, 0.76, 1.0]).tolist() == [1.0, 2.0, 2.0, 3.0, 3.0]


@pytest.mark.parametrize("scale", [1, 10**9])
def test_draws_keep_sizes_and_moments(scale):
    """Means and variances are those of draws without replacement, below and beyond the limit of numpy's own."""
    total = np.array([30, 50, 20]) * scale
    rows, take = int(total.sum()), 40 * scale
    rng = np.random.default_rng(1)
    drawn = np.array([M.drawn_counts(rng, total, take) for _ in range(4000 if scale == 1 else 60)])
    assert (drawn.sum(1) == take).all() and (drawn >= 0).all() and (drawn <= total).all()
    mean = take * (total / rows)
    deviation = np.sqrt(mean * (1 - total / rows) * ((rows - take) / (rows - 1)))
    assert (np.abs(drawn.mean(0) - mean) < 5 * deviation / np.sqrt(len(drawn))).all()
    if scale == 1:
        assert (np.abs(drawn.std(0) / deviation - 1) < 0.06).all()
        both = [np.random.default_rng(2).multivariate_hypergeometric(total, take, 40_000)[:, 0]]
        share = lambda a: np.bincount(a, minlength=31)[:31] / len(a)
        assert np.abs(share(drawn[:, 0]) - share(both[0])).max() < 0.03
    assert M.drawn_counts(rng, total, 0).sum() == 0 and (M.drawn_counts(rng, total, rows) == total).all()
