"""Tests, intervals and fits beyond SQL (inventory ST): no oracle, held against numpy and known values by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import inference as I
from larkspur.operators import mixed
from larkspur.operators import statistics as S
from larkspur.operators.aggregates import rate_where
from larkspur.plans.statistics import ROUNDS, model_moments, model_pairs
from larkspur.registry import query

TRIED = lambda v, *more: v.evals.select("model_family", F.col("k").cast("double").alias("x"), F.col("is_correct").cast("double").alias("y"), *more)


@query("st1_welch_test")
def welch_test(v):
    return I.t_tests(model_pairs(v)).select(F.col("model_id_a").alias("a"), F.col("model_id_b").alias("b"), "difference", "t", "df", "p", F.col("t_low").alias("low"), F.col("t_high").alias("high"))


@query("st6_power")
def power(v):
    return I.t_tests(model_pairs(v)).select(F.col("model_id_a").alias("a"), F.col("model_id_b").alias("b"), "d", "power")


@query("st5_ab_test_full")
def ab_test_full(v):
    """Control and treatment of each model: lift, Welch's t, p and power."""
    x = F.col("is_correct").cast("double")
    arms = v.evals.groupBy("model_id", "run_id").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    a, b = (arms.filter(F.col("run_id") == run).drop("run_id").toDF("model_id", *[c + s for c in ("n", "mean", "var")]) for run, s in (("run_b", "_a"), ("run_a", "_b")))
    tested = I.t_tests(S.welch(a.join(b, "model_id")))
    return tested.select("model_id", F.col("mean_b").alias("control"), F.col("mean_a").alias("treatment"), F.try_divide(F.col("difference"), F.col("mean_b")).alias("lift"), "t", "p", "power")


@query("st9_paired_t_corrected")
def paired_t_corrected(v):
    """Paired tests of all model pairs on items, the latest answer of each counting, with Holm's correction."""
    from larkspur.operators.joins import aligned_pairs
    from larkspur.operators.windows import latest

    last = latest(v.evals, ["model_id", "item_id"], F.desc("timestamp"), F.desc("eval_id")).select("model_id", "item_id", F.col("is_correct").cast("double").alias("v"))
    d = aligned_pairs(last, "model_id", "item_id", "v").withColumn("d", F.col("value_a") - F.col("value_b"))
    g = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("deviation")).filter("n > 2")
    t = F.try_divide(F.col("mean"), F.col("deviation") / F.sqrt("n"))
    return S.corrected(I.paired_tests(g.withColumn("t", t)), "p", "holm", "a", "b")


@query("st10_t_interval")
def t_interval(v):
    return I.t_intervals(model_moments(v))


@query("st12_stratified_bootstrap")
def stratified_bootstrap(v):
    joined = v.evals.join(v.items.select("item_id", "domain"), "item_id")
    return I.stratified_bootstrap(joined.select("model_family", "domain", "transform", F.col("is_correct").cast("double").alias("x")), "model_family", ["domain", "transform"], ROUNDS)


@query("st14_bca_interval")
def bca_interval(v):
    return I.bca_interval(v.evals.select("model_id", F.col("latency_ms").cast("double").alias("x")), "model_id", ROUNDS)


@query("st15_bootstrap_spearman")
def bootstrap_spearman(v):
    return I.spearman_bootstrap(v.evals.select("model_id", F.coalesce("scramble_level", F.lit(0.0)).alias("x"), F.col("is_correct").cast("double").alias("y")), "model_id", ROUNDS)


@query("st16_parameter_bootstrap")
def parameter_bootstrap(v):
    return I.parameter_bootstrap(TRIED(v), "model_family", ROUNDS)


@query("st17_significant_parameters")
def significant_parameters(v):
    return I.parameter_bootstrap(TRIED(v), "model_family", ROUNDS).filter("significant").select("model_family", "parameter", "estimate", "low", "high")


@query("st19_interaction")
def interaction(v):
    tried = v.evals.select("model_family", F.log10("n_params").alias("x"), F.col("is_correct").cast("double").alias("y"), (F.col("transform") != "original").cast("double").alias("c"))
    return I.interaction_fit(tried, "model_family")


def mixed_fit(v):
    joined = v.evals.join(v.items.select("item_id", "domain"), "item_id")
    tried = joined.select(F.col("is_correct").cast("double").alias("y"), F.log10("n_params").alias("size"), F.coalesce("scramble_level", F.lit(0.0)).alias("level"), "domain", "model_family")
    return mixed.random_intercepts(tried, "y", ["size", "level"], ["domain", "model_family"])


@query("st20_random_intercepts")
def random_intercepts(v):
    """Logistic fit of correctness on size and scrambling, with crossed random intercepts of domain and family."""
    return mixed.table(v.spark, mixed_fit(v))


@query("st21_spline")
def spline(v):
    return I.family_models(TRIED(v), "model_family").filter("model = 'spline'").drop("chosen", "ratio", "p")


@query("st23_likelihood_ratio_test")
def likelihood_ratio_test(v):
    return I.family_models(TRIED(v), "model_family").filter("p is not null").select("model_family", "model", "ratio", "p")


@query("st28_family_models")
def family_models(v):
    return I.family_models(TRIED(v), "model_family")


@query("st24_fitted_weights")
def fitted_weights(v):
    """Information weights of the fitted models of each family."""
    fits = I.family_models(TRIED(v), "model_family").withColumnRenamed("model", "name")
    return S.information_weights(fits, "aic", ["model_family"]).select("model_family", "name", "delta", "weight", "rank", "running", "evidence")


@query("st27_contamination_fit")
def contamination_fit(v):
    """Loss under scrambling per model and level, on size, divergence and fragmentation of tokens."""
    base = v.evals.groupBy("model_id").agg(rate_where("transform = 'original'").alias("base"))
    levels = v.evals.filter("scramble_level is not null").groupBy("model_id", "scramble_level").agg(F.avg(F.col("is_correct").cast("double")).alias("acc"), F.log10(F.first("n_params")).alias("log_n"), F.avg("tok_kl").alias("tok_kl"), F.avg("tok_frag").alias("tok_frag"))
    return I.contamination_fit(levels.join(base, "model_id").withColumn("delta", F.col("base") - F.col("acc")), "delta", ["log_n", "tok_kl", "tok_frag"])


@query("st30_polynomials")
def polynomials(v):
    return I.polynomial_fits(v.evals.select("transform", F.col("k").cast("double").alias("x"), F.col("latency_ms").cast("double").alias("y")), "transform", "x", "y")
