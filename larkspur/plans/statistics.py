"""Statistics (inventory ST and information criteria)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import inference as I
from larkspur.operators import models as M
from larkspur.operators import statistics as S
from larkspur.operators.aggregates import rate_where, wilson
from larkspur.registry import query

R = lambda c: F.round(c, 6)
#: Rounds of resampling, as many as the reference takes.
ROUNDS = 2000
MOMENTS = "WITH m AS (SELECT model_id, count(*) n, avg(CAST(is_correct AS INTEGER)) a, var_samp(CAST(is_correct AS INTEGER)) v FROM levels GROUP BY model_id), "


def model_moments(v):
    return S.moments(v.levels, "model_id", F.col("is_correct").cast("double"))


def model_pairs(v):
    m = model_moments(v)
    a, b = (m.select(*[F.col(c).alias(c + s) for c in m.columns]) for s in ("_a", "_b"))
    return S.welch(a.join(b, F.col("model_id_a") < F.col("model_id_b")))


@query("st1_welch", MOMENTS + """p AS (SELECT x.model_id a, y.model_id b, x.a - y.a d, sqrt(x.v / x.n + y.v / y.n) se FROM m x JOIN m y ON x.model_id < y.model_id)
SELECT a, b, round(d, 6) difference, round(d / nullif(se, 0), 5) t, round(d - 1.96 * se, 6) low, round(d + 1.96 * se, 6) high FROM p""")
def welch(v):
    return model_pairs(v).select(F.col("model_id_a").alias("a"), F.col("model_id_b").alias("b"), R("difference").alias("difference"), F.round("t", 5).alias("t"), R("low").alias("low"), R("high").alias("high"))


@query("st2_cohens_d", MOMENTS + "p AS (SELECT x.model_id a, y.model_id b, (x.a - y.a) / nullif(sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)), 0) d FROM m x JOIN m y ON x.model_id < y.model_id) SELECT a, b, round(d, 6) d FROM p")
def cohens_d(v):
    return model_pairs(v).select(F.col("model_id_a").alias("a"), F.col("model_id_b").alias("b"), R("d").alias("d"))


@query("st3_wilson", "SELECT experiment_id, model_id, intensity, ci_low, ci_high FROM metrics")
def wilson_interval(v):
    low, high = wilson(F.avg(F.col("is_correct").cast("double")), F.count(F.lit(1)))
    return v.levels.groupBy("experiment_id", "model_id", "intensity").agg(R(low).alias("ci_low"), R(high).alias("ci_high"))


@query("st5_ab_test", """SELECT model_id, round(avg(CASE WHEN run_id = 'run_a' THEN CAST(is_correct AS INTEGER) END), 6) control, round(avg(CASE WHEN run_id = 'run_b' THEN CAST(is_correct AS INTEGER) END), 6) treatment,
 round(avg(CASE WHEN run_id = 'run_b' THEN CAST(is_correct AS INTEGER) END) / nullif(avg(CASE WHEN run_id = 'run_a' THEN CAST(is_correct AS INTEGER) END), 0) - 1, 6) lift FROM evals GROUP BY model_id""")
def ab_test(v):
    a, b = rate_where("run_id = 'run_a'"), rate_where("run_id = 'run_b'")
    return v.evals.groupBy("model_id").agg(R(a).alias("control"), R(b).alias("treatment"), R(F.try_divide(b, a) - 1).alias("lift"))


@query("st7_level_spearman", """WITH l AS (SELECT model_id, intensity, avg(CAST(is_correct AS INTEGER)) acc FROM levels GROUP BY ALL),
r AS (SELECT model_id, rank() OVER (PARTITION BY model_id ORDER BY intensity) + (count(*) OVER (PARTITION BY model_id, intensity) - 1) / 2.0 x, rank() OVER (PARTITION BY model_id ORDER BY acc) + (count(*) OVER (PARTITION BY model_id, acc) - 1) / 2.0 y FROM l)
SELECT model_id, count(*) n, round(corr(x, y), 6) rho FROM r GROUP BY model_id""")
def level_spearman(v):
    means = v.levels.groupBy("model_id", "intensity").agg(F.avg(F.col("is_correct").cast("double")).alias("acc"))
    return S.spearman(means, ["model_id"], "intensity", "acc").select("model_id", "n", R("rho").alias("rho"))


@query("st8_thresholds", "SELECT * FROM thresholds")
def thresholds(v):
    return v.thresholds


@query("st9_paired_t", """WITH s AS (SELECT model_id, item_id, avg(CAST(is_correct AS INTEGER)) v FROM evals GROUP BY ALL), d AS (SELECT a.model_id a, b.model_id b, a.v - b.v d FROM s a JOIN s b ON a.item_id = b.item_id AND a.model_id <> b.model_id)
SELECT a, b, count(*) n, round(avg(d) / nullif(stddev_samp(d), 0), 6) effect, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 5) t FROM d GROUP BY a, b HAVING count(*) > 2""")
def paired_t(v):
    from larkspur.operators.joins import aligned_pairs

    s = v.evals.groupBy("model_id", "item_id").agg(F.avg(F.col("is_correct").cast("double")).alias("v"))
    d = aligned_pairs(s, "model_id", "item_id", "v").withColumn("d", F.col("value_a") - F.col("value_b"))
    g = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd")).filter("n > 2")
    return g.select("a", "b", "n", R(F.try_divide("m", "sd")).alias("effect"), F.round(F.try_divide(F.col("m"), F.col("sd") / F.sqrt("n")), 5).alias("t"))


P_VALUES = "WITH p AS (SELECT DISTINCT k, (k + 1) / 500.0 p FROM evals), n AS (SELECT k, p, row_number() OVER (ORDER BY p, k) i, count(*) OVER () m FROM p) "


def p_values(v):
    return v.evals.select("k").distinct().withColumn("p", (F.col("k") + 1) / 500.0)


@query("st18_bonferroni", P_VALUES + "SELECT k, round(least(1, p * m), 6) adjusted FROM n")
def bonferroni(v):
    return S.corrected(p_values(v), "p", "bonferroni", "k").select("k", R("adjusted").alias("adjusted"))


@query("st18_holm", P_VALUES + "SELECT k, round(least(1, max(p * (m - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) adjusted FROM n")
def holm(v):
    return S.corrected(p_values(v), "p", "holm", "k").select("k", R("adjusted").alias("adjusted"))


@query("st18_benjamini_hochberg", P_VALUES + "SELECT k, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) adjusted FROM n")
def benjamini_hochberg(v):
    return S.corrected(p_values(v), "p", "bh", "k").select("k", R("adjusted").alias("adjusted"))


@query("st11_permutation", None)
def permutation(v):
    groups = v.evals.filter("model_family in ('alpha', 'gamma')").select(F.col("model_family").alias("g"), F.col("is_correct").cast("double").alias("x"))
    return M.permutation_test(groups, "alpha", "gamma", ROUNDS)


@query("st12_bootstrap", None)
def bootstrap(v):
    return M.bootstrap_mean(v.evals.select("model_family", F.col("is_correct").cast("double").alias("x")), "model_family", ROUNDS)


@query("st13_percentile_interval", "SELECT model_id, quantile_cont(k, 0.025) low, quantile_cont(k, 0.975) high FROM evals GROUP BY model_id")
def percentile_interval(v):
    return v.evals.groupBy("model_id").agg(F.percentile("k", 0.025).alias("low"), F.percentile("k", 0.975).alias("high"))


@query("st19_logistic", None)
def logistic(v):
    return M.logistic_by_family(v.evals.select("model_family", F.log10("n_params").alias("x"), F.col("is_correct").cast("double").alias("y")), "model_family")


@query("st22_segmented", None)
def segmented(v):
    return M.segmented_by_family(v.evals.select("model_family", F.log10("n_params").alias("x"), F.col("is_correct").cast("double").alias("y")), "model_family")


#: Three models of latency for each family: a constant, a line in k, a mean for each transform.
FITS_SQL = """WITH e AS (SELECT model_family, transform, CAST(k AS DOUBLE) x, CAST(latency_ms AS DOUBLE) y FROM evals WHERE k IS NOT NULL AND latency_ms IS NOT NULL),
whole AS (SELECT model_family, count(*) n, avg(y) mean, var_pop(y) v, var_pop(x) vx, regr_slope(y, x) slope, regr_intercept(y, x) icept, regr_r2(y, x) r2 FROM e GROUP BY model_family),
parts AS (SELECT model_family, sum(c * v) AS wss, count(*) AS groups, max(m) FILTER (transform = 'scramble') AS of FROM (SELECT model_family, transform, count(*) c, var_pop(y) v, avg(y) m FROM e GROUP BY ALL) GROUP BY model_family),
raw AS (SELECT model_family, n, 'constant' AS name, 2 AS parameters, v * n AS rss, mean AS predicted FROM whole UNION ALL SELECT model_family, n, 'linear', 3, v * n * (1 - r2), icept + slope * 50 FROM whole
    UNION ALL SELECT model_family, n, 'grouped', groups + 1, wss, of FROM whole JOIN parts USING (model_family)),
lik AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1) ll FROM raw),
fits AS (SELECT *, 2 * parameters - 2 * ll AS aic, parameters * ln(n) - 2 * ll AS bic FROM lik) """


def fits(v):
    return S.gaussian_fits(v.evals, "model_family", "k", "latency_ms", "transform", 50.0, "scramble")


def weights_sql(c):
    return FITS_SQL + f""", w AS (SELECT *, {c} - min({c}) OVER (PARTITION BY model_family) delta FROM fits), x AS (SELECT *, exp(-0.5 * delta) / sum(exp(-0.5 * delta)) OVER (PARTITION BY model_family) weight FROM w)
SELECT model_family, name, round(delta, 5) delta, round(weight, 6) weight, row_number() OVER o AS rank, round(sum(weight) OVER (o ROWS UNBOUNDED PRECEDING), 6) running, round(delta / 2, 5) log_evidence FROM x WINDOW o AS (PARTITION BY model_family ORDER BY delta, name)"""


def weights(v, c):
    five = lambda x: F.round(x, 5).alias(x)
    return S.information_weights(fits(v), c, ["model_family"]).select("model_family", "name", five("delta"), R("weight").alias("weight"), F.col("rank").cast("bigint").alias("rank"), R("running").alias("running"), five("log_evidence"))


@query("st24_aic_weights", weights_sql("aic"))
def aic_weights(v):
    return weights(v, "aic")


@query("st24_bic_weights", weights_sql("bic"))
def bic_weights(v):
    return weights(v, "bic")


@query("st23_likelihood_ratio", FITS_SQL + "SELECT a.model_family, b.name AS complex, round(2 * (b.ll - a.ll), 5) lr, CAST(b.parameters - a.parameters AS BIGINT) df FROM fits a JOIN fits b ON a.model_family = b.model_family AND a.name = 'constant' AND b.name <> 'constant'")
def likelihood_ratio(v):
    """Of each model against the constant, which is nested in it."""
    f = fits(v).select("model_family", "name", "log_likelihood", "parameters")
    base = f.filter("name = 'constant'").select("model_family", F.col("log_likelihood").alias("ll"), F.col("parameters").alias("p"))
    return f.filter("name != 'constant'").join(base, "model_family").select("model_family", F.col("name").alias("complex"), F.round(2 * (F.col("log_likelihood") - F.col("ll")), 5).alias("lr"), (F.col("parameters") - F.col("p")).alias("df"))


@query("st25_best_model", FITS_SQL + "SELECT model_family, name, aic_rank + bic_rank composite, CASE WHEN aic_rank = 1 AND bic_rank = 1 THEN 'agreed' WHEN aic_rank = 1 OR bic_rank = 1 THEN 'split' ELSE 'no' END best FROM (SELECT model_family, name, rank() OVER (PARTITION BY model_family ORDER BY aic) aic_rank, rank() OVER (PARTITION BY model_family ORDER BY bic) bic_rank FROM fits)")
def best_model(v):
    f = fits(v).select("model_family", "name", *[F.rank().over(Window.partitionBy("model_family").orderBy(c)).cast("bigint").alias(c[0]) for c in ("aic", "bic")])
    return f.select("model_family", "name", (F.col("a") + F.col("b")).alias("composite"), F.when((F.col("a") == 1) & (F.col("b") == 1), "agreed").when((F.col("a") == 1) | (F.col("b") == 1), "split").otherwise("no").alias("best"))


@query("st26_model_averaging", FITS_SQL + ", w AS (SELECT model_family, predicted y, exp(-0.5 * (aic - min(aic) OVER (PARTITION BY model_family))) e FROM fits), m AS (SELECT model_family, sum(e * y) / sum(e) mean FROM w GROUP BY model_family) SELECT model_family, round(max(mean), 5) mean, round(sum(e * pow(y - mean, 2)) / sum(e), 5) AS variance FROM w JOIN m USING (model_family) GROUP BY model_family")
def model_averaging(v):
    """What the three models predict for k = 50 under scrambling, averaged by weight."""
    w = S.information_weights(fits(v), "aic", ["model_family"])
    mean = F.sum(F.col("weight") * F.col("predicted"))
    by = Window.partitionBy("model_family")
    w = w.withColumn("mean", F.sum(F.col("weight") * F.col("predicted")).over(by))
    return w.groupBy("model_family").agg(F.round(mean, 5).alias("mean"), F.round(F.sum(F.col("weight") * F.pow(F.col("predicted") - F.col("mean"), 2)), 5).alias("variance"))


@query("st27_contamination_slopes", """WITH d AS (SELECT model_id, log10(n_params) x, avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END) - avg(CASE WHEN transform = 'scramble' THEN CAST(is_correct AS INTEGER) END) y FROM evals GROUP BY ALL)
SELECT round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept, round(regr_r2(y, x), 6) r2 FROM d""")
def contamination_slopes(v):
    d = v.evals.groupBy("model_id", F.log10("n_params").alias("x")).agg((rate_where("transform = 'original'") - rate_where("transform = 'scramble'")).alias("y"))
    return d.agg(R(F.regr_slope("y", "x")).alias("slope"), R(F.regr_intercept("y", "x")).alias("intercept"), R(F.regr_r2("y", "x")).alias("r2"))


@query("st29_linear_fit", "SELECT transform, round(regr_slope(latency_ms, k), 6) slope, round(regr_intercept(latency_ms, k), 5) intercept, round(regr_r2(latency_ms, k), 6) r2 FROM evals GROUP BY transform")
def linear_fit(v):
    return v.evals.groupBy("transform").agg(R(F.regr_slope("latency_ms", "k")).alias("slope"), F.round(F.regr_intercept("latency_ms", "k"), 5).alias("intercept"), R(F.regr_r2("latency_ms", "k")).alias("r2"))


@query("st31_ldc_interval", "SELECT m.experiment_id, m.model_id, m.intensity, round(greatest(0, 1 - m.ci_high / b.accuracy), 5) low, round(least(1, 1 - m.ci_low / b.accuracy), 5) high FROM metrics m JOIN metrics b ON m.experiment_id = b.experiment_id AND m.model_id = b.model_id AND b.intensity = 0 AND m.intensity > 0 AND b.accuracy > 0")
def ldc_interval(v):
    base = F.max(F.when(F.col("intensity") == 0, F.col("accuracy"))).over(Window.partitionBy("experiment_id", "model_id"))
    m = v.metrics.withColumn("base", base).filter("intensity > 0 and base > 0")
    return m.select("experiment_id", "model_id", "intensity", F.round(F.greatest(F.lit(0.0), 1 - F.col("ci_high") / F.col("base")), 5).alias("low"), F.round(F.least(F.lit(1.0), 1 - F.col("ci_low") / F.col("base")), 5).alias("high"))


@query("st34_robustness_curve", """WITH a AS (SELECT model_id, intensity x, avg(CAST(is_correct AS INTEGER)) y FROM levels GROUP BY ALL), s AS (SELECT model_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 part, first_value(y) OVER w y0, max(x) OVER (PARTITION BY model_id) - min(x) OVER (PARTITION BY model_id) span FROM a WINDOW w AS (PARTITION BY model_id ORDER BY x))
SELECT model_id, round(1 - sum(part) / nullif(max(y0 * span), 0), 6) crs FROM s GROUP BY model_id""")
def robustness_curve(v):
    w = Window.partitionBy("model_id").orderBy("x")
    a = v.levels.groupBy("model_id", F.col("intensity").alias("x")).agg(F.avg(F.col("is_correct").cast("double")).alias("y"))
    whole = Window.partitionBy("model_id")
    s = a.select("model_id", ((F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2).alias("part"), F.first("y").over(w).alias("y0"), (F.max("x").over(whole) - F.min("x").over(whole)).alias("span"))
    return s.groupBy("model_id").agg(R(1 - F.try_divide(F.sum("part"), F.max(F.col("y0") * F.col("span")))).alias("crs"))


@query("st32_mann_whitney", """WITH r AS (SELECT event_type, event_id % 10 < 8 AS first, value, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value)),
t AS (SELECT event_type, sum(CAST(c AS DOUBLE) * c * c - c) ties FROM (SELECT event_type, value, count(*) c FROM events WHERE value IS NOT NULL GROUP BY ALL) GROUP BY event_type),
s AS (SELECT event_type, count(*) FILTER (first) a, count(*) FILTER (NOT first) b, sum(rk) FILTER (first) ranks FROM r GROUP BY event_type)
SELECT event_type, a AS n_a, b AS n_b, ranks - a * (a + 1) / 2 AS u, ties, round((ranks - a * (a + 1) / 2 - a * b / 2.0) / sqrt(a * b / 12.0 * (a + b + 1 - ties / ((a + b) * (a + b - 1.0)))), 6) z FROM s JOIN t USING (event_type)""")
def mann_whitney(v):
    """Values of events of both runs, for each kind of event."""
    e = v.raw("events").withColumn("run", F.when(F.col("event_id") % 10 < 8, "a").otherwise("b"))
    return S.rank_sums(e, "event_type", "run", "a", "b", "value").withColumn("z", R("z"))


@query("st32_mann_whitney_p")
def mann_whitney_p(v):
    return I.normal_p(mann_whitney(v))


CELLS_SQL = """WITH c AS (SELECT transform r, CAST(is_correct AS INTEGER) c, count(*) o FROM evals WHERE is_correct IS NOT NULL GROUP BY ALL), m AS (SELECT r, c, o, sum(o) OVER (PARTITION BY r) nr, sum(o) OVER (PARTITION BY c) nc, sum(o) OVER () n FROM c),
x AS (SELECT max(n) n, max(n) * (sum(o / nr * o / nc) - 1) chi2, count(DISTINCT r) k, count(DISTINCT c) l FROM m) """


@query("st32_chi_squared", CELLS_SQL + "SELECT CAST(n AS BIGINT) n, round(chi2, 5) chi2, (k - 1) * (l - 1) df, round(sqrt(chi2 / (n * (least(k, l) - 1))), 6) cramers_v FROM x")
def chi_squared(v):
    """Whether correctness depends on the transform; Cramer's V goes with it (ST33)."""
    return S.contingency(v.evals.select("transform", F.col("is_correct").cast("int").alias("c")), "transform", "c").select("n", F.round("chi2", 5).alias("chi2"), "df", R("cramers_v").alias("cramers_v"))


@query("st33_eta_squared", "SELECT model_id, round(between_ / (between_ + wss), 6) eta_squared, round(between_, 3) between_ss FROM (SELECT model_id, sum(n * pow(m - gm, 2)) between_, sum(n * v) AS wss FROM (SELECT *, sum(n * m) OVER (PARTITION BY model_id) / sum(n) OVER (PARTITION BY model_id) gm FROM (SELECT model_id, transform, count(*) n, avg(latency_ms) m, var_pop(latency_ms) v FROM evals GROUP BY ALL)) GROUP BY model_id)")
def eta_squared(v):
    """Share of the spread of latency that transforms explain, for each model."""
    y = F.col("latency_ms").cast("double")
    g = v.evals.groupBy("model_id", "transform").agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    by = Window.partitionBy("model_id")
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(by) / F.sum("n").over(by))
    between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)), F.sum(F.col("n") * F.col("v"))
    return g.groupBy("model_id").agg(R(F.try_divide(between, between + within)).alias("eta_squared"), F.round(between, 3).alias("between_ss"))
