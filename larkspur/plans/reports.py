"""Report aggregates, rankings and remaining projections (inventory A, PF, J, W, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import aggregates as A
from larkspur.operators import statistics as S
from larkspur.plans.candidates import CANDIDATES, candidates
from larkspur.registry import query

R = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1))


@query("a7_paraphrase_quality", CANDIDATES + "SELECT candidate_id - item_id AS apart, count(*) n, count(*) FILTER (accepted) accepted, round(avg(cos_sim), 5) similarity, round(avg(edit_ratio), 6) edit FROM candidates GROUP BY 1")
def paraphrase_quality(v):
    return candidates(v).groupBy((F.col("candidate_id") - F.col("item_id")).alias("apart")).agg(N().alias("n"), F.count_if("accepted").alias("accepted"), F.round(F.avg("cos_sim"), 5).alias("similarity"), R(F.avg("edit_ratio")).alias("edit"))


@query("a29_by_answer_type", r"SELECT CASE WHEN regexp_full_match(lower(trim(answer)), '[a-zà-ÿ]+') THEN 'word' ELSE 'other' END kind, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy FROM evals JOIN items USING (item_id) GROUP BY ALL")
def by_answer_type(v):
    kind = F.when(F.rlike(F.lower(F.trim("answer")), F.lit("^[a-zà-ÿ]+$")), "word").otherwise("other")
    return v.evals.join(v.items.select("item_id", kind.alias("kind")), "item_id").groupBy("kind").agg(N().alias("n"), R(A.rate()).alias("accuracy"))


@query("a35_binary_f1", """SELECT model_id, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 FROM (SELECT model_id, count(*) FILTER (is_correct AND k >= 50) tp, count(*) FILTER (is_correct AND k < 50) fp, count(*) FILTER (NOT is_correct AND k >= 50) fn FROM evals GROUP BY model_id)""")
def binary_f1(v):
    c, high = F.col("is_correct"), F.col("k") >= 50
    tp, fp, fn = F.count_if(c & high), F.count_if(c & ~high), F.count_if(~c & high)
    return v.evals.groupBy("model_id").agg(R(F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))).alias("f1"))


@query("a36_accuracy_per_model", "SELECT model_id, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy FROM evals GROUP BY model_id")
def accuracy_per_model(v):
    return v.evals.groupBy("model_id").agg(R(A.rate()).alias("accuracy"))


@query("a39_success_rate", "SELECT round(avg(CAST(is_correct AS INTEGER)), 6) rate FROM evals WHERE model_id = 'm2' AND transform = 'paraphrase'")
def success_rate(v):
    return v.evals.filter("model_id = 'm2' and transform = 'paraphrase'").agg(R(A.rate()).alias("rate"))


@query("a41_transformation_stats", "SELECT transform, count(*) n, count(*) FILTER (is_correct) successes, round(count(*) FILTER (is_correct) / count(*), 6) share FROM evals GROUP BY transform")
def transformation_stats(v):
    return v.evals.groupBy("transform").agg(N().alias("n"), F.count_if("is_correct").alias("successes"), R(F.count_if("is_correct") / N()).alias("share"))


@query("a42_error_rates", "SELECT user_id % 8 AS model, count(*) requests, count(*) FILTER (event_type = 'error') errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) rate FROM events GROUP BY ALL")
def error_rates(v):
    bad = F.count_if(F.col("event_type") == "error")
    return v.raw("events").groupBy((F.col("user_id") % 8).alias("model")).agg(N().alias("requests"), bad.alias("errors"), R(bad / N()).alias("rate"))


@query("a44_performance_summary", "SELECT experiment_id, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 4) accuracy, round(avg(response_time_ms), 2) avg_time, round(sum(cost), 4) cost, count(DISTINCT model_id) models FROM responses GROUP BY experiment_id")
def performance_summary(v):
    return v.responses.groupBy("experiment_id").agg(N().alias("n"), F.round(A.rate(), 4).alias("accuracy"), F.round(F.avg("response_time_ms"), 2).alias("avg_time"), F.round(F.sum("cost"), 4).alias("cost"), F.count_distinct("model_id").alias("models"))


@query("a45_comparison_table", "SELECT model_id, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 4) accuracy, round(stddev_samp(CAST(is_correct AS INTEGER)), 4) sd FROM responses GROUP BY model_id")
def comparison_table(v):
    return v.responses.groupBy("model_id").agg(N().alias("n"), F.round(A.rate(), 4).alias("accuracy"), F.round(F.stddev_samp(F.col("is_correct").cast("double")), 4).alias("sd"))


@query("a49_report_summary", "SELECT round(avg(k), 6) mean, median(k) median, round(stddev_pop(k), 6) sd, min(k) least, max(k) most, CAST(sum(latency_ms) AS BIGINT) duration FROM evals")
def report_summary(v):
    return v.evals.agg(R(F.avg("k")).alias("mean"), F.median("k").alias("median"), R(F.stddev_pop("k")).alias("sd"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("latency_ms").alias("duration"))


@query("a50_counterparts", "SELECT dataset, array_to_string(list_sort(list(DISTINCT model_id)), ',') models, count(*) n FROM evals JOIN items USING (item_id) GROUP BY dataset")
def counterparts(v):
    return v.evals.join(v.items.select("item_id", "dataset"), "item_id").groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("models"), N().alias("n"))


@query("a55_run_summary", "SELECT run_id, count(DISTINCT model_id) models, count(DISTINCT dataset) datasets, count(DISTINCT domain) domains, round(avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END), 6) original FROM evals JOIN items USING (item_id) GROUP BY run_id")
def run_summary(v):
    j = v.evals.join(v.items.select("item_id", "dataset", "domain"), "item_id")
    return j.groupBy("run_id").agg(F.count_distinct("model_id").alias("models"), F.count_distinct("dataset").alias("datasets"), F.count_distinct("domain").alias("domains"), R(A.rate_where("transform = 'original'")).alias("original"))


@query("a58_survey_progress", "SELECT round(avg(done), 6) completion, round(avg(rate) FILTER (done > 0), 6) success FROM (SELECT model_id, count(*) FILTER (run_id = 'run_a') / count(*) done, avg(CAST(is_correct AS INTEGER)) rate FROM evals GROUP BY model_id)")
def survey_progress(v):
    m = v.evals.groupBy("model_id").agg((F.count_if(F.col("run_id") == "run_a") / N()).alias("done"), A.rate().alias("rate"))
    return m.agg(R(F.avg("done")).alias("completion"), R(F.avg(F.when(F.col("done") > 0, F.col("rate")))).alias("success"))


#: Prices by name; variants of a name cost the same unless they are listed.
PRICES = {"ring": 1.0, "hot ring": 0.4, "bolt": 0.2, "plate": 3.0, "small plate": 2.5, "large widget": 7.5}


def price_sql(name, prices, default):
    exact = "".join(f" WHEN {name} = '{k}' THEN {{0}}" .replace("{0}", f"struct_pack(price := {v}::DOUBLE, kind := 'exact')") for k, v in prices.items())
    part = "".join(f" WHEN contains({name}, '{k}') OR contains('{k}', {name}) THEN struct_pack(price := {prices[k]}::DOUBLE, kind := 'part')" for k in sorted(prices, key=lambda k: (-len(k), k)))
    return f"CASE{exact}{part} ELSE struct_pack(price := {default}::DOUBLE, kind := 'default') END"


@query("a62_price_lookup", f"SELECT p_partkey, p_name, x.price AS price, x.kind AS kind FROM (SELECT p_partkey, p_name, {price_sql('p_name', PRICES, 2.0)} x FROM part)")
def price_lookup(v):
    from larkspur.functions.score import price

    cost, kind = price(F.col("p_name"), PRICES, 2.0)
    return v.raw("part").select("p_partkey", "p_name", cost.alias("price"), kind.alias("kind"))


@query("a64_rejections", CANDIDATES + "SELECT CASE WHEN cos_sim < 0.85 AND edit_ratio < 0.25 THEN 'both' WHEN cos_sim < 0.85 THEN 'semantic' WHEN edit_ratio < 0.25 THEN 'surface' ELSE 'none' END kind, count(*) n FROM candidates GROUP BY ALL")
def rejections(v):
    sem, sur = F.col("cos_sim") < 0.85, F.col("edit_ratio") < 0.25
    return candidates(v).groupBy(F.when(sem & sur, "both").when(sem, "semantic").when(sur, "surface").otherwise("none").alias("kind")).agg(N().alias("n"))


@query("a65_quality_dimensions", CANDIDATES + "SELECT candidate_id - item_id AS apart, round(0.4 * avg(cos_sim) + 0.3 * avg(edit_ratio) + 0.2 * avg(CAST(accepted AS INTEGER)) + 0.1 * count(*) / 1000, 5) score FROM candidates GROUP BY 1")
def quality_dimensions(v):
    score = 0.4 * F.avg("cos_sim") + 0.3 * F.avg("edit_ratio") + 0.2 * F.avg(F.col("accepted").cast("int")) + 0.1 * N() / 1000
    return candidates(v).groupBy((F.col("candidate_id") - F.col("item_id")).alias("apart")).agg(F.round(score, 5).alias("score"))


@query("a70_model_table", """SELECT model_id, n_params, round(a, 6) original, round(p, 6) paraphrase, round(s, 6) scramble, round(s / nullif(a, 0), 6) rrs, round(1 - s / nullif(a, 0), 6) ldc FROM (SELECT model_id, n_params, avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END) a,
 avg(CASE WHEN transform = 'paraphrase' THEN CAST(is_correct AS INTEGER) END) p, avg(CASE WHEN transform = 'scramble' THEN CAST(is_correct AS INTEGER) END) s FROM evals GROUP BY ALL)""")
def model_table(v):
    a, p, s = (A.rate_where(f"transform = '{t}'") for t in ("original", "paraphrase", "scramble"))
    return v.evals.groupBy("model_id", "n_params").agg(R(a).alias("original"), R(p).alias("paraphrase"), R(s).alias("scramble"), R(F.try_divide(s, a)).alias("rrs"), R(1 - F.try_divide(s, a)).alias("ldc"))


@query("a71_family_trend", """WITH m AS (SELECT model_family, model_id, n_params, 1 - avg(CASE WHEN transform = 'scramble' THEN CAST(is_correct AS INTEGER) END) / nullif(avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END), 0) ldc FROM evals GROUP BY ALL)
SELECT model_family, count(*) n, round(avg(ldc), 6) ldc FROM m GROUP BY model_family""")
def family_trend(v):
    ldc = 1 - F.try_divide(A.rate_where("transform = 'scramble'"), A.rate_where("transform = 'original'"))
    return v.evals.groupBy("model_family", "model_id", "n_params").agg(ldc.alias("l")).groupBy("model_family").agg(N().alias("n"), R(F.avg("l")).alias("ldc"))


@query("a76_transform_accuracy", "SELECT transform, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) mean, round(100 * avg(CAST(is_correct AS INTEGER)), 4) pct FROM evals GROUP BY transform")
def transform_accuracy(v):
    return v.evals.groupBy("transform").agg(N().alias("n"), R(A.rate()).alias("mean"), F.round(100 * A.rate(), 4).alias("pct"))


@query("a78_health_scalars", "SELECT (SELECT count(*) FROM experiments WHERE status = 'running') running, (SELECT count(*) FROM responses) responses, (SELECT count(DISTINCT model_id) FROM responses) models")
def health_scalars(v):
    running = v.experiments.filter("status = 'running'").agg(N().alias("running"))
    return running.crossJoin(v.responses.agg(N().alias("responses"), F.count_distinct("model_id").alias("models")))


@query("a80_operation_stats", "SELECT event_type operation, count(*) calls, round(sum(value), 5) total, round(avg(value), 6) mean, round(min(value), 6) least, round(max(value), 6) most FROM events GROUP BY event_type")
def operation_stats(v):
    return v.raw("events").groupBy(F.col("event_type").alias("operation")).agg(N().alias("calls"), F.round(F.sum("value"), 5).alias("total"), R(F.avg("value")).alias("mean"), R(F.min("value")).alias("least"), R(F.max("value")).alias("most"))


@query("a81_domain_drop", "SELECT domain, round(avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END), 6) base, round(avg(CASE WHEN intensity = 50 THEN CAST(is_correct AS INTEGER) END), 6) at_50 FROM levels GROUP BY domain")
def domain_drop(v):
    return v.levels.groupBy("domain").agg(R(A.rate_where("intensity = 0")).alias("base"), R(A.rate_where("intensity = 50")).alias("at_50"))


@query("a84_plan_size", "SELECT count(*) * (SELECT sum(CASE WHEN kind = 'scramble' THEN levels ELSE 1 END) FROM (VALUES ('original', 0), ('paraphrase', 0), ('scramble', 3)) t(kind, levels))::BIGINT AS evaluations FROM items")
def plan_size(v):
    per = v.spark.sql("SELECT SUM(CASE WHEN kind = 'scramble' THEN size(levels) ELSE 1 END) AS per FROM VALUES ('original', array()), ('paraphrase', array()), ('scramble', array(0.1, 0.3, 0.5)) AS t(kind, levels)")
    return v.items.agg(N().alias("n")).crossJoin(per).select((F.col("n") * F.col("per")).alias("evaluations"))


@query("a85_frozen_items", "SELECT dataset, array_to_string(list_sort(list(item_id)), ',') ids, count(*) n FROM (SELECT dataset, item_id, row_number() OVER (PARTITION BY dataset ORDER BY md5('3' || item_id), item_id) k FROM items) WHERE k <= 2 GROUP BY dataset")
def frozen_items(v):
    k = F.row_number().over(Window.partitionBy("dataset").orderBy(F.md5(F.concat(F.lit("3"), "item_id")), "item_id"))
    return v.items.withColumn("k", k).filter("k <= 2").groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"), N().alias("n"))


@query("a89_last_errors", "SELECT model_id, array_to_string(list_slice(list(eval_id ORDER BY timestamp DESC, eval_id DESC), 1, 5), ',') last FROM evals WHERE NOT is_correct GROUP BY model_id")
def last_errors(v):
    w = Window.partitionBy("model_id").orderBy(F.desc("timestamp"), F.desc("eval_id"))
    last = v.evals.filter("not is_correct").withColumn("n", F.row_number().over(w)).filter("n <= 5")
    return last.groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "eval_id"))), lambda s: s["eval_id"]), ",").alias("last"))


STARS_SQL = "CASE WHEN abs(t) > 3.291 THEN '***' WHEN abs(t) > 2.576 THEN '**' WHEN abs(t) > 1.96 THEN '*' ELSE '' END"


@query("a91_parameter_table", """WITH e AS (SELECT model_family, CAST(k AS DOUBLE) x, CAST(latency_ms AS DOUBLE) y FROM evals WHERE k IS NOT NULL),
m AS (SELECT model_family, avg(y) mean, regr_slope(y, x) slope, regr_intercept(y, x) icept, sqrt(var_pop(y) * (1 - regr_r2(y, x)) / ((count(*) - 2) * var_pop(x))) se FROM e GROUP BY model_family)
SELECT model_family, 'intercept' AS parameter, round(mean, 5) AS constant, round(icept, 5) AS linear, CAST(NULL AS DOUBLE) se, CAST(NULL AS DOUBLE) low, CAST(NULL AS DOUBLE) high, '' AS stars FROM m
UNION ALL SELECT model_family, 'slope', NULL, round(slope, 6), round(se, 6), round(slope - 1.96 * se, 6), round(slope + 1.96 * se, 6), """ + STARS_SQL.replace("t)", "slope / se)") + " FROM m")
def parameter_table(v):
    """Parameters by model of the fits of latency, for each family, with the slope's interval and stars."""
    from larkspur.plans.statistics import fits

    f = fits(v).groupBy("model_family").agg(*[F.max(F.when(F.col("name") == "constant", F.col("predicted"))).alias("mean"), *[F.max(c).alias(c) for c in ("intercept", "slope", "slope_se")]])
    t = F.abs(F.try_divide(F.col("slope"), F.col("slope_se")))
    stars = F.when(t > 3.291, "***").when(t > 2.576, "**").when(t > 1.96, "*").otherwise("")
    none = F.lit(None).cast("double")
    row = lambda p, *c: F.struct(F.lit(p).alias("parameter"), *[x.alias(n) for x, n in zip(c, ("constant", "linear", "se", "low", "high", "stars"))])
    se, slope = F.col("slope_se"), F.col("slope")
    return f.select("model_family", F.inline(F.array(row("intercept", F.round("mean", 5), F.round("intercept", 5), none, none, none, F.lit("")), row("slope", none, R(slope), R(se), R(slope - 1.96 * se), R(slope + 1.96 * se), stars))))


@query("pf15_filter_results", "SELECT eval_id FROM evals WHERE model_id = 'm5' AND transform = 'paraphrase'")
def filter_results(v):
    return v.evals.filter((F.col("model_id") == "m5") & (F.col("transform") == "paraphrase")).select("eval_id")


@query("pf18_family_filter", "SELECT model_id, model_family, count(*) n FROM evals WHERE model_family IN ('alpha', 'gamma') GROUP BY ALL")
def family_filter(v):
    return v.evals.filter(F.col("model_family").isin("alpha", "gamma")).groupBy("model_id", "model_family").agg(N().alias("n"))


@query("pf20_recommendation", """WITH a AS (SELECT model_id, avg(CASE WHEN run_id = 'run_b' THEN CAST(is_correct AS INTEGER) END) - avg(CASE WHEN run_id = 'run_a' THEN CAST(is_correct AS INTEGER) END) lift FROM evals GROUP BY model_id)
SELECT model_id, CASE WHEN lift > 0.02 THEN 'adopt' WHEN lift < -0.02 THEN 'keep' ELSE 'collect more' END advice, printf('%.2f', lift) shown FROM a""")
def recommendation(v):
    a = v.evals.groupBy("model_id").agg((A.rate_where("run_id = 'run_b'") - A.rate_where("run_id = 'run_a'")).alias("lift"))
    return a.select("model_id", F.when(F.col("lift") > 0.02, "adopt").when(F.col("lift") < -0.02, "keep").otherwise("collect more").alias("advice"), F.format_string("%.2f", "lift").alias("shown"))


@query("pf24_newest_runs", "SELECT run_id, max(timestamp) last_at, count(*) n FROM evals GROUP BY run_id ORDER BY last_at DESC LIMIT 1")
def newest_runs(v):
    return v.evals.groupBy("run_id").agg(F.max("timestamp").alias("last_at"), N().alias("n")).orderBy(F.desc("last_at")).limit(1)


@query("pf27_ordered_lookup", "SELECT eval_id, timestamp FROM evals WHERE run_id = 'run_b' AND is_correct ORDER BY timestamp, eval_id LIMIT 50")
def ordered_lookup(v):
    return v.evals.filter("run_id = 'run_b' and is_correct").select("eval_id", "timestamp").orderBy("timestamp", "eval_id").limit(50)


@query("j10_ground_truth", "SELECT e.model_id, count(*) n, round(avg(CASE WHEN e.is_correct = (l.quality = 1) THEN 1 ELSE 0 END), 6) accuracy FROM evals e JOIN labels l ON e.item_id = 'i' || l.doc_id WHERE l.quality IS NOT NULL GROUP BY e.model_id")
def ground_truth(v):
    """Agreement of outcomes with the labels of all labelled items; items without a label are dropped."""
    truth = v.raw("labels").filter("quality is not null").select(F.concat(F.lit("i"), "doc_id").alias("item_id"), (F.col("quality") == 1).alias("truth"))
    agree = F.when(F.col("is_correct") == F.col("truth"), 1).otherwise(0)
    return v.evals.join(truth, "item_id").groupBy("model_id").agg(N().alias("n"), R(F.avg(agree)).alias("accuracy"))


def evidence_sql():
    from larkspur.plans.statistics import FITS_SQL

    return FITS_SQL + """, w AS (SELECT *, aic - min(aic) OVER f da, bic - min(bic) OVER f db FROM fits WINDOW f AS (PARTITION BY model_family)), x AS (SELECT *, exp(-0.5 * da) / sum(exp(-0.5 * da)) OVER f wa, exp(-0.5 * db) / sum(exp(-0.5 * db)) OVER f wb FROM w WINDOW f AS (PARTITION BY model_family))
SELECT model_family, name, row_number() OVER a AS aic_rank, row_number() OVER b AS bic_rank, round(wa, 6) aic_weight, round(sum(wa) OVER (a ROWS UNBOUNDED PRECEDING), 6) running, round(da / 2, 5) log_evidence, coalesce(sum(wa) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.95 AS top FROM x
WINDOW a AS (PARTITION BY model_family ORDER BY da, name), b AS (PARTITION BY model_family ORDER BY db, name)"""


@query("w3_evidence_ranks", evidence_sql())
def evidence_ranks(v):
    """Models of each family by both criteria, with running weight, evidence against the best, and whether they are in the 95 % set."""
    from larkspur.plans.statistics import fits

    by = ["model_family"]
    a = S.information_weights(fits(v), "aic", by)
    b = S.information_weights(fits(v), "bic", by).select("model_family", "name", F.col("rank").cast("bigint").alias("bic_rank"))
    return a.join(b, ["model_family", "name"]).select("model_family", "name", F.col("rank").cast("bigint").alias("aic_rank"), "bic_rank", R("weight").alias("aic_weight"), R("running").alias("running"), F.round("log_evidence", 5).alias("log_evidence"), (F.col("running") - F.col("weight") < 0.95).alias("top"))


@query("f29_importance")
def importance(v):
    s = v.raw("documents").select("doc_id", F.inline(T.sections(F.col("text"), "\n")))
    return s.select("doc_id", "position", T.importance(T.section_type(F.col("content")), F.col("content")).alias("importance"))


@query("f42_builtins", "SELECT event_id, round(sqrt(abs(value)), 6) root, least(value, 50.0) low, greatest(value, 50.0) high, replace(event_type, 'e', 'E') t FROM events")
def builtins(v):
    return v.raw("events").select("event_id", R(F.sqrt(F.abs("value"))).alias("root"), F.least("value", F.lit(50.0)).alias("low"), F.greatest("value", F.lit(50.0)).alias("high"), F.replace("event_type", F.lit("e"), F.lit("E")).alias("t"))


@query("f44_checksum", "SELECT conv_id, sha256(string_agg(role || ':' || text, '|' ORDER BY turn)) checksum FROM conversations GROUP BY conv_id")
def checksum(v):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("t")))), lambda s: s["t"])
    return v.raw("conversations").groupBy("conv_id").agg(F.sha2(F.array_join(parts, "|"), 256).alias("checksum"))


@query("st4_corrected_pairs", """WITH m AS (SELECT model_id, count(*) n, avg(CAST(is_correct AS INTEGER)) a, var_samp(CAST(is_correct AS INTEGER)) v FROM levels GROUP BY model_id HAVING count(*) >= 10)
SELECT x.model_id a, y.model_id b, count(*) OVER () comparisons, round(0.05 / count(*) OVER (), 6) level FROM m x JOIN m y ON x.model_id < y.model_id""")
def corrected_pairs(v):
    m = S.moments(v.levels, "model_id", F.col("is_correct").cast("double")).filter("n >= 10").select("model_id")
    p = m.select(F.col("model_id").alias("a")).join(m.select(F.col("model_id").alias("b")), F.col("a") < F.col("b"))
    count = N().over(Window.partitionBy())
    return p.select("a", "b", count.alias("comparisons"), R(0.05 / count).alias("level"))


@query("st32_anova_f", """WITH g AS (SELECT model_family, count(*) n, avg(latency_ms) m, var_samp(latency_ms) v FROM evals GROUP BY model_family), t AS (SELECT sum(n * m) / sum(n) gm, sum(n) tn, count(*) k FROM g)
SELECT round((sum(n * pow(m - gm, 2)) / (max(k) - 1)) / (sum((n - 1) * v) / (max(tn) - max(k))), 5) f, CAST(max(k) - 1 AS BIGINT) df1, CAST(max(tn) - max(k) AS BIGINT) df2 FROM g, t""")
def anova_f(v):
    g = S.moments(v.evals, "model_family", F.col("latency_ms").cast("double"))
    everything = Window.partitionBy()
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("mean")).over(everything) / F.sum("n").over(everything))
    k, n = N(), F.sum("n")
    between, within = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("gm"), 2)) / (k - 1), F.sum((F.col("n") - 1) * F.col("var")) / (n - k)
    return g.agg(F.round(between / within, 5).alias("f"), (k - 1).alias("df1"), (n - k).alias("df2"))


@query("st33_effect_sizes", """WITH g AS (SELECT avg(latency_ms) FILTER (model_family = 'alpha') a, avg(latency_ms) FILTER (model_family = 'gamma') b, stddev_samp(latency_ms) FILTER (model_family = 'alpha') s, stddev_samp(latency_ms) FILTER (model_family = 'gamma') t, count(*) FILTER (model_family = 'alpha') n, count(*) FILTER (model_family = 'gamma') m FROM evals)
SELECT round((a - b) / t, 6) glass, round((a - b) / sqrt(((n - 1) * s * s + (m - 1) * t * t) / (n + m - 2)) * (1 - 3 / (4.0 * (n + m) - 9)), 6) hedges FROM g""")
def effect_sizes(v):
    x = lambda f, g: f(F.when(F.col("model_family") == g, F.col("latency_ms")))
    a, b, s, t, n, m = (x(f, g) for f in (F.avg, F.stddev_samp, F.count) for g in ("alpha", "gamma"))
    pooled = F.sqrt(((n - 1) * s * s + (m - 1) * t * t) / (n + m - 2))
    return v.evals.agg(R((a - b) / t).alias("glass"), R((a - b) / pooled * (1 - 3 / (4.0 * (n + m) - 9))).alias("hedges"))
