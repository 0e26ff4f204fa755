"""Distributions against published values, and intervals and fits against numpy on all rows."""

import numpy as np
import pandas as pd
import pytest

from larkspur import registry
from larkspur.functions import evaluators
from larkspur.operators import distributions as D
from larkspur.operators import inference as I


@pytest.mark.parametrize("df, p, t", [(1, 0.975, 12.7062), (5, 0.975, 2.5706), (10, 0.95, 1.8125), (30, 0.995, 2.7500), (120, 0.975, 1.9799)])
def test_t_quantiles_of_tables(df, p, t):
    assert abs(float(D.t_quantile(p, df)) - t) < 5e-5
    assert abs(float(D.t_cdf(t, df)) - p) < 1e-4 and abs(float(D.t_two_sided(t, df)) - 2 * (1 - p)) < 2e-4


@pytest.mark.parametrize("df, x", [(1, 3.8415), (2, 5.9915), (5, 11.0705), (10, 18.3070)])
def test_chi_squared_of_tables(df, x):
    assert abs(float(D.chi2_upper(x, df)) - 0.05) < 1e-5


def test_normal_and_power():
    assert abs(float(D.normal_quantile(0.975)) - 1.959964) < 1e-6
    assert abs(D.t_test_power(0.5, 64, 64) - 0.8015) < 1e-3  # Cohen's tables
    assert abs(D.t_test_power(0.8, 20, 20) - 0.6934) < 1e-3
    assert abs(D.t_test_power(0.0, 30, 30) - 0.05) < 1e-3
    rng = np.random.default_rng(0)
    drawn = (rng.normal(size=200_000) + 1.5) / np.sqrt(rng.chisquare(7, 200_000) / 7)
    assert abs(D.noncentral_t_cdf(2.0, 7, 1.5) - (drawn <= 2.0).mean()) < 5e-3


def evals(spark, sf):
    from larkspur.plans import bridge

    return bridge.views(spark, sf).evals.toPandas()


def run(spark, sf, name):
    return registry.QUERIES[name](spark, sf).toPandas()


def test_welch_and_intervals(spark, sf):
    e = run(spark, sf, "st10_t_interval").set_index("model_id")
    for _, r in run(spark, sf, "st1_welch_test").iterrows():
        a, b = e.loc[r.a], e.loc[r.b]
        se = np.sqrt(a["var"] / a.n + b["var"] / b.n)
        assert abs(r.difference - (a["mean"] - b["mean"])) < 1e-9 and abs(r.t - r.difference / se) < 1e-9 and r.df == a.n + b.n - 2
        assert abs(r.p - 2 * (1 - float(D.t_cdf(abs(r.t), r.df)))) < 1e-9 and abs((r.high - r.low) / 2 - float(D.t_quantile(0.975, r.df)) * se) < 1e-9
    for _, r in e.iterrows():
        assert r.low < r["mean"] < r.high
    power = run(spark, sf, "st6_power")
    for r in power.itertuples():
        assert abs(r.power - D.t_test_power(r.d, int(e.n[r.a]), int(e.n[r.b]))) < 1e-9
    full = run(spark, sf, "st5_ab_test_full")
    assert (abs(full.lift - (full.treatment / full.control - 1)) < 1e-9).all()


def test_resampled_intervals_hold_the_statistic(spark, sf):
    e = evals(spark, sf)
    by_family = e.groupby("model_family").is_correct.mean()
    for _, r in run(spark, sf, "st12_stratified_bootstrap").iterrows():
        assert abs(r["mean"] - by_family[r.model_family]) < 1e-9 and r.low < r["mean"] < r.high
    for _, r in run(spark, sf, "st14_bca_interval").iterrows():
        own = e[e.model_id == r.model_id].latency_ms.to_numpy(float)
        se = own.std(ddof=1) / np.sqrt(len(own))
        assert abs(r["mean"] - own.mean()) < 1e-6 and abs(r.low - (own.mean() - 1.96 * se)) < se and abs(r.high - (own.mean() + 1.96 * se)) < se
    e["level"] = e.scramble_level.fillna(0.0)
    for _, r in run(spark, sf, "st15_bootstrap_spearman").iterrows():
        own = e[e.model_id == r.model_id]
        rho = np.corrcoef(own.level.rank(), own.is_correct.astype(float).rank())[0, 1]
        assert r.n == len(own) and abs(r.rho - rho) < 1e-9 and r.low < r.rho < r.high


def test_paired_tests(spark, sf):
    e = evals(spark, sf).sort_values(["timestamp", "eval_id"]).groupby(["model_id", "item_id"]).last().is_correct.astype(float).unstack("model_id")
    found = run(spark, sf, "st9_paired_t_corrected")
    order = found.sort_values(["p", "a", "b"])
    worst = 0.0
    for k, r in enumerate(order.itertuples()):
        d = (e[r.a] - e[r.b]).dropna()
        assert r.n == len(d) and abs(r.mean - d.mean()) < 1e-9
        if d.std(ddof=1) > 0:
            assert abs(r.t - d.mean() / (d.std(ddof=1) / np.sqrt(len(d)))) < 1e-6
        worst = min(1.0, max(worst, r.p * (len(order) - k)))
        assert abs(r.adjusted - worst) < 1e-9


def log_likelihood(design, b, y):
    p = 1 / (1 + np.exp(-design @ b))
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_logistic_fits_are_stationary_and_nested(spark, sf):
    e = evals(spark, sf)
    for family, terms in run(spark, sf, "st19_interaction").groupby("model_family"):
        own = e[e.model_family == family]
        x, c, y = np.log10(own.n_params), (own["transform"] != "original").astype(float), own.is_correct.to_numpy(float)
        design = np.column_stack([np.ones(len(own)), x, c, x * c])
        b = terms.set_index("term").estimate[["intercept", "x", "condition", "x:condition"]].to_numpy()
        assert np.abs(design.T @ (y - 1 / (1 + np.exp(-design @ b)))).max() < 1e-3
        assert terms.p.between(0, 1).all()
    fits = run(spark, sf, "st28_family_models")
    for family, f in fits.groupby("model_family"):
        f = f.set_index("model")
        assert f.log_likelihood["linear"] <= f.log_likelihood["segmented"] + 1e-6 and f.log_likelihood["linear"] <= f.log_likelihood["spline"] + 1e-6
        assert np.allclose(f.aic, 2 * f.parameters - 2 * f.log_likelihood) and f.chosen.sum() == 1 and f.aic[f.chosen].iloc[0] == f.aic.min()
        assert abs(f.p["segmented"] - float(D.chi2_upper(2 * (f.log_likelihood["segmented"] - f.log_likelihood["linear"]), 2))) < 1e-9
    assert len(run(spark, sf, "st21_spline")) == fits.model_family.nunique() and len(run(spark, sf, "st23_likelihood_ratio_test")) == 2 * fits.model_family.nunique()
    assert (abs(run(spark, sf, "st24_fitted_weights").groupby("model_family").weight.sum() - 1) < 1e-9).all()


def test_parameters_and_their_intervals(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, 4000).astype(float)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * x - 2)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"model_family": "f", "x": x, "y": y}))
    found = I.parameter_bootstrap(df, "model_family", 200).toPandas().set_index("parameter")
    assert (found.low["slope"] < 0.5 < found.high["slope"]) and (found.low["intercept"] < -2 < found.high["intercept"]) and found.significant.all()


def test_spline_basis_spans_cubics_and_bends():
    x = np.linspace(0, 9, 200)
    basis = I.spline_basis(x, np.array([2.0, 5.0, 7.0]))
    assert basis.shape == (200, 7)
    for y in (x**3 - 4 * x, np.maximum(x - 5, 0) ** 3):
        b = np.linalg.lstsq(basis, y, rcond=None)[0]
        assert np.abs(basis @ b - y).max() < 1e-6


def test_least_squares(spark, sf):
    e = evals(spark, sf)
    for r in run(spark, sf, "st30_polynomials").itertuples():
        own = e[e["transform"] == r.transform]
        b = np.polynomial.polynomial.polyfit(own.k.astype(float), own.latency_ms.astype(float), r.degree)
        rest = own.latency_ms - np.polynomial.polynomial.polyval(own.k.astype(float), b)
        assert np.allclose(r.coefficients, b, rtol=1e-4, atol=1e-6) and abs(r.r2 - (1 - rest.var() / own.latency_ms.var())) < 1e-4 and abs(r.band - 1.96 * np.sqrt((rest**2).mean())) < 1e-2
    rng = np.random.default_rng(2)
    table = pd.DataFrame(rng.normal(size=(60, 3)), columns=["a", "b", "y"])
    got = I.contamination_fit(spark.createDataFrame(table), "y", ["a", "b"]).toPandas().set_index("term").estimate
    want = np.linalg.lstsq(np.column_stack([np.ones(60), table.a, table.b]), table.y, rcond=None)[0]
    assert np.allclose(got[["intercept", "a", "b"]], want)
    assert len(run(spark, sf, "st27_contamination_fit")) == 4


def test_semantic_evaluator_is_the_share_of_matching_text(spark, sf):
    import difflib

    from larkspur.plans import bridge

    pairs = bridge.views(spark, sf).qa_pairs.toPandas().set_index(["conv_id", "turn"])
    for r in run(spark, sf, "f4_semantic").itertuples():
        p = pairs.loc[(r.conv_id, r.turn)]
        ratio = difflib.SequenceMatcher(None, p.predicted.strip().lower(), p.question.strip().lower()).ratio()
        assert r.correct == (ratio >= 0.8)
    with pytest.raises(ValueError):
        evaluators.evaluated("none such", None, None)
