"""Aggregate queries (inventory A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import aggregates as A
from larkspur.operators import windows as W
from larkspur.functions import score
from larkspur.registry import query

R = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1))


@query("canonical_metrics", """
WITH cells AS (SELECT model_id, transform, scramble_level, count(*) n, avg(CAST(is_correct AS INTEGER)) acc FROM evals GROUP BY ALL),
base AS (SELECT model_id, acc AS acc0 FROM cells WHERE transform = 'original')
SELECT model_id, transform, scramble_level, n, round(acc, 6) acc, round(acc0, 6) acc0, round(coalesce(acc / nullif(acc0, 0), 0), 6) rrs,
  round(CASE WHEN acc0 > 0 THEN 1 - acc / acc0 ELSE 0 END, 6) ldc FROM cells LEFT JOIN base USING (model_id)""")
def canonical(v):
    return A.canonical_metrics(v.evals, ["model_id"]).select("model_id", "transform", "scramble_level", "n", *[R(c).alias(c) for c in ("acc", "acc0", "rrs", "ldc")])


@query("a1_original_accuracy", "SELECT run_id, model_id, round(avg(CAST(is_correct AS INTEGER)), 6) acc0, count(*) n FROM evals WHERE transform = 'original' GROUP BY ALL")
def original_accuracy(v):
    return v.evals.filter("transform = 'original'").groupBy("run_id", "model_id").agg(R(A.rate()).alias("acc0"), N().alias("n"))


@query("a2_metrics_by_domain", """
WITH cells AS (SELECT e.model_id, i.domain, transform, scramble_level, count(*) n, avg(CAST(is_correct AS INTEGER)) acc FROM evals e JOIN items i USING (item_id) GROUP BY ALL),
base AS (SELECT model_id, domain, acc AS acc0 FROM cells WHERE transform = 'original')
SELECT model_id, domain, transform, scramble_level, n, round(coalesce(acc / nullif(acc0, 0), 0), 6) rrs FROM cells LEFT JOIN base USING (model_id, domain)""")
def metrics_by_domain(v):
    joined = v.evals.join(v.items.select("item_id", "domain"), "item_id")
    return A.canonical_metrics(joined, ["model_id", "domain"]).select("model_id", "domain", "transform", "scramble_level", "n", R("rrs").alias("rrs"))


@query("a3_run_stats", """
SELECT run_id, count(*) total, count(is_correct) completed, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) correct, round(avg(latency_ms), 6) avg_latency,
  round(sum(cost_usd), 6) total_cost, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy FROM evals GROUP BY run_id""")
def run_stats(v):
    return v.evals.groupBy("run_id").agg(N().alias("total"), F.count("is_correct").alias("completed"), F.count_if("is_correct").alias("correct"), R(F.avg("latency_ms")).alias("avg_latency"), R(F.sum("cost_usd")).alias("total_cost"), R(A.rate()).alias("accuracy"))


@query("a4_model_performance", """
SELECT model_id, count(*) total, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) correct, round(sum(CAST(is_correct AS INTEGER)) / count(*), 6) accuracy,
  round(avg(latency_ms), 6) avg_latency, CAST(sum(k) AS BIGINT) tokens, round(sum(latency_ms) / count(*), 6) latency_over_all FROM evals GROUP BY model_id""")
def model_performance(v):
    return v.evals.groupBy("model_id").agg(N().alias("total"), F.count_if("is_correct").alias("correct"), R(F.count_if("is_correct") / N()).alias("accuracy"), R(F.avg("latency_ms")).alias("avg_latency"), F.sum("k").alias("tokens"), R(F.sum("latency_ms") / N()).alias("latency_over_all"))


@query("a5_transform_comparison", """
SELECT transform || coalesce('_' || scramble_level, '') AS key, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy, round(avg(cost_usd), 9) avg_cost FROM evals GROUP BY ALL""")
def transform_comparison(v):
    return v.evals.groupBy(F.concat_ws("_", "transform", F.col("scramble_level").cast("string")).alias("key")).agg(N().alias("n"), R(A.rate()).alias("accuracy"), F.round(F.avg("cost_usd"), 9).alias("avg_cost"))


def _aggregates(v):
    return A.canonical_metrics(v.evals, ["run_id", "model_id"])


AGGREGATES = """WITH cells AS (SELECT run_id, model_id, transform, scramble_level, avg(CAST(is_correct AS INTEGER)) acc FROM evals GROUP BY ALL),
base AS (SELECT run_id, model_id, acc acc0 FROM cells WHERE transform = 'original'),
aggregates AS (SELECT run_id, model_id, transform, scramble_level, acc, coalesce(acc / nullif(acc0, 0), 0) rrs, CASE WHEN acc0 > 0 THEN 1 - acc / acc0 ELSE 0 END ldc FROM cells LEFT JOIN base USING (run_id, model_id))
"""


@query("a6_mean_by_model_and_transform", AGGREGATES + "SELECT model_id, transform, round(avg(acc), 6) acc, round(avg(rrs), 6) rrs, round(avg(ldc), 6) ldc, count(*) n FROM aggregates GROUP BY model_id, transform")
def mean_by_model_and_transform(v):
    return _aggregates(v).groupBy("model_id", "transform").agg(*[R(F.avg(c)).alias(c) for c in ("acc", "rrs", "ldc")], N().alias("n"))


@query("s2_dependency_ranking", AGGREGATES + "SELECT model_id, round(avg(ldc), 6) ldc FROM aggregates WHERE transform = 'scramble' GROUP BY model_id ORDER BY ldc DESC, model_id LIMIT 5")
def dependency_ranking(v):
    return _aggregates(v).filter("transform = 'scramble'").groupBy("model_id").agg(R(F.avg("ldc")).alias("ldc")).orderBy(F.desc("ldc"), "model_id").limit(5)


@query("pf10_performance_categories", AGGREGATES + """SELECT run_id, model_id, transform, scramble_level, CASE WHEN acc >= .9 THEN 'excellent' WHEN acc >= .7 THEN 'good' WHEN acc >= .5 THEN 'fair' ELSE 'poor' END performance,
 CASE WHEN ldc <= .2 THEN 'low' WHEN ldc <= .5 THEN 'moderate' WHEN ldc <= .8 THEN 'high' ELSE 'very_high' END dependency FROM aggregates""")
def performance_categories(v):
    level = F.when(F.col("acc") >= 0.9, "excellent").when(F.col("acc") >= 0.7, "good").when(F.col("acc") >= 0.5, "fair").otherwise("poor")
    need = F.when(F.col("ldc") <= 0.2, "low").when(F.col("ldc") <= 0.5, "moderate").when(F.col("ldc") <= 0.8, "high").otherwise("very_high")
    return _aggregates(v).select("run_id", "model_id", "transform", "scramble_level", level.alias("performance"), need.alias("dependency"))


@query("a8_coverage", """SELECT count(DISTINCT i.item_id) items, count(DISTINCT CASE WHEN e.transform = 'paraphrase' THEN i.item_id END) cached, count(DISTINCT CASE WHEN e.transform = 'paraphrase' AND is_correct THEN i.item_id END) accepted,
 round(count(DISTINCT CASE WHEN e.transform = 'paraphrase' THEN i.item_id END) / count(DISTINCT i.item_id), 6) coverage FROM items i LEFT JOIN evals e USING (item_id)""")
def coverage(v):
    j = v.items.select("item_id").join(v.evals.select("item_id", "transform", "is_correct"), "item_id", "left")
    done = F.when(F.col("transform") == "paraphrase", F.col("item_id"))
    return j.agg(F.count_distinct("item_id").alias("items"), F.count_distinct(done).alias("cached"), F.count_distinct(F.when(F.col("is_correct"), done)).alias("accepted"), R(F.count_distinct(done) / F.count_distinct("item_id")).alias("coverage"))


@query("a9_status_counts", """SELECT count(*) total, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) completed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) failed,
 round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*), 6) completion_rate FROM events""")
def status_counts(v):
    done = F.count_if(F.col("event_type") == "purchase")
    return v.raw("events").agg(N().alias("total"), done.alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"), R(done / N()).alias("completion_rate"))


@query("a10_family_dependency", """SELECT family, count(DISTINCT t.model_id) models, round(avg(ldc), 6) avg_ldc, round(stddev_samp(ldc), 6) std_ldc, round(min(ldc), 6) min_ldc, round(max(ldc), 6) max_ldc
 FROM thresholds t JOIN models m USING (model_id) GROUP BY family HAVING count(DISTINCT t.model_id) >= 2""")
def family_dependency(v):
    j = v.thresholds.join(v.models.select("model_id", "family"), "model_id")
    return j.groupBy("family").agg(F.count_distinct("model_id").alias("models"), *[R(f("ldc")).alias(f"{n}_ldc") for n, f in (("avg", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]).filter("models >= 2")


@query("a11_family_by_intensity", """SELECT family, intensity, round(avg(accuracy), 6) avg_accuracy, round(stddev_samp(accuracy), 6) std_accuracy, count(DISTINCT model_id) models
 FROM metrics JOIN models USING (model_id) GROUP BY ALL HAVING count(DISTINCT model_id) >= 2""")
def family_by_intensity(v):
    j = v.metrics.join(v.models.select("model_id", "family"), "model_id")
    return j.groupBy("family", "intensity").agg(R(F.avg("accuracy")).alias("avg_accuracy"), R(F.stddev_samp("accuracy")).alias("std_accuracy"), F.count_distinct("model_id").alias("models")).filter("models >= 2")


@query("w1_retention_curve", """WITH f AS (SELECT family, intensity, avg(accuracy) acc FROM metrics JOIN models USING (model_id) GROUP BY ALL)
SELECT family, intensity, round(acc, 6) acc, round(acc / nullif(first_value(acc) OVER (PARTITION BY family ORDER BY intensity), 0), 6) retention FROM f""")
def retention_curve(v):
    f = v.metrics.join(v.models.select("model_id", "family"), "model_id").groupBy("family", "intensity").agg(F.avg("accuracy").alias("acc"))
    first = F.first("acc").over(Window.partitionBy("family").orderBy("intensity"))
    return f.select("family", "intensity", R("acc").alias("acc"), R(F.try_divide("acc", first)).alias("retention"))


@query("a12_thresholds_by_family", """SELECT family, count(*) n, round(avg(threshold_intensity), 6) mean_threshold, round(median(threshold_intensity), 6) median_threshold, round(avg(baseline_accuracy), 6) baseline
 FROM thresholds JOIN models USING (model_id) WHERE threshold_intensity IS NOT NULL GROUP BY family HAVING count(*) >= 1""")
def thresholds_by_family(v):
    j = v.thresholds.filter("threshold_intensity is not null").join(v.models.select("model_id", "family"), "model_id")
    return j.groupBy("family").agg(N().alias("n"), R(F.avg("threshold_intensity")).alias("mean_threshold"), R(F.median("threshold_intensity")).alias("median_threshold"), R(F.avg("baseline_accuracy")).alias("baseline"))


@query("a13_domain_by_family", """SELECT domain, family, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy, round(avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END) - avg(CASE WHEN intensity > 0 THEN CAST(is_correct AS INTEGER) END), 6) drop_
 FROM levels JOIN models USING (model_id) GROUP BY domain, family""")
def domain_by_family(v):
    j = v.levels.join(v.models.select("model_id", "family"), "model_id")
    return j.groupBy("domain", "family").agg(N().alias("n"), R(A.rate()).alias("accuracy"), R(A.rate_where("intensity = 0") - A.rate_where("intensity > 0")).alias("drop_"))


LOAD = "CASE WHEN n_words < 150 THEN 'low' WHEN n_words < 400 THEN 'medium' ELSE 'high' END"


@query("a14_cognitive_load", f"SELECT {LOAD} load, intensity, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy, round(avg(response_time_ms), 6) avg_time FROM levels GROUP BY ALL")
def cognitive_load(v):
    return v.levels.groupBy(F.expr(LOAD).alias("load"), "intensity").agg(N().alias("n"), R(A.rate()).alias("accuracy"), R(F.avg("response_time_ms")).alias("avg_time"))


@query("a15_drop_by_question", """SELECT question_id, domain, round(avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END), 6) base, round(avg(CASE WHEN intensity > 0 THEN CAST(is_correct AS INTEGER) END), 6) scrambled_accuracy,
 round(avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END) - avg(CASE WHEN intensity > 0 THEN CAST(is_correct AS INTEGER) END), 6) drop_ FROM levels GROUP BY ALL HAVING count(*) >= 5""")
def drop_by_question(v):
    base, scrambled = A.rate_where("intensity = 0"), A.rate_where("intensity > 0")
    return v.levels.groupBy("question_id", "domain").agg(R(base).alias("base"), R(scrambled).alias("scrambled_accuracy"), R(base - scrambled).alias("drop_"), N().alias("n")).filter("n >= 5").drop("n")


@query("a16_model_comparison", """WITH c AS (SELECT experiment_id, model_id, sum(cost) cost, count(*) responses FROM responses GROUP BY ALL),
m AS (SELECT experiment_id, model_id, avg(CASE WHEN intensity = 0 THEN accuracy END) base, avg(CASE WHEN intensity > 0 THEN accuracy END) scr, CAST(sum(total_questions) AS BIGINT) questions FROM metrics GROUP BY ALL)
SELECT experiment_id, model_id, round(base, 6) base, round(scr, 6) scr, questions, round(cost, 6) cost, responses FROM m JOIN c USING (experiment_id, model_id) WHERE questions >= 10""")
def model_comparison(v):
    cost = v.responses.groupBy("experiment_id", "model_id").agg(R(F.sum("cost")).alias("cost"), N().alias("responses"))
    m = v.metrics.groupBy("experiment_id", "model_id").agg(R(F.avg(F.expr("case when intensity = 0 then accuracy end"))).alias("base"), R(F.avg(F.expr("case when intensity > 0 then accuracy end"))).alias("scr"), F.sum("total_questions").alias("questions"))
    return m.filter("questions >= 10").join(cost, ["experiment_id", "model_id"])


@query("a17_pairwise_differences", """WITH s AS (SELECT model_id, avg(CAST(is_correct AS INTEGER)) m, stddev_samp(CAST(is_correct AS INTEGER)) sd, count(*) n FROM levels GROUP BY model_id)
SELECT a.model_id a, b.model_id b, round(a.m - b.m, 6) difference, round(sqrt(pow(a.sd, 2) / a.n + pow(b.sd, 2) / b.n), 6) se FROM s a JOIN s b ON a.model_id < b.model_id WHERE abs(a.m - b.m) > 0.05""")
def pairwise_differences(v):
    hit = F.col("is_correct").cast("double")
    s = v.levels.groupBy("model_id").agg(F.avg(hit).alias("m"), F.stddev_samp(hit).alias("sd"), N().alias("n"))
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.model_id") < F.col("b.model_id")) & (F.abs(F.col("a.m") - F.col("b.m")) > 0.05))
    return j.select(F.col("a.model_id").alias("a"), F.col("b.model_id").alias("b"), R(F.col("a.m") - F.col("b.m")).alias("difference"), R(F.expr("sqrt(pow(a.sd, 2) / a.n + pow(b.sd, 2) / b.n)")).alias("se"))


@query("a18_reproducibility", """SELECT experiment_name, config_hash, count(DISTINCT model_id) models, count(response_id) responses, min(timestamp) first_at, max(timestamp) last_at FROM experiments LEFT JOIN responses USING (experiment_id) GROUP BY ALL""")
def reproducibility(v):
    j = v.experiments.join(v.responses, "experiment_id", "left")
    return j.groupBy("experiment_name", "config_hash").agg(F.count_distinct("model_id").alias("models"), F.count("response_id").alias("responses"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


@query("a19_completeness", """SELECT experiment_id, count(*) total, count(*) FILTER (is_correct) correct, count(*) FILTER (response_time_ms > 100) slow, round(100.0 * count(token_count) / count(*), 6) completeness FROM responses GROUP BY experiment_id""")
def completeness(v):
    return v.responses.groupBy("experiment_id").agg(N().alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("response_time_ms") > 100).alias("slow"), R(100.0 * F.count("token_count") / N()).alias("completeness"))


@query("a20_performance_export", "SELECT model_id, intensity, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy, round(stddev_samp(CAST(is_correct AS INTEGER)), 6) sd, round(avg(response_time_ms), 6) avg_time FROM levels GROUP BY ALL HAVING count(*) >= 10")
def performance_export(v):
    hit = F.col("is_correct").cast("double")
    return v.levels.groupBy("model_id", "intensity").agg(N().alias("n"), R(F.avg(hit)).alias("accuracy"), R(F.stddev_samp(hit)).alias("sd"), R(F.avg("response_time_ms")).alias("avg_time")).filter("n >= 10")


@query("a21_anova_frame", "SELECT model_id, family, domain, intensity, CAST(is_correct AS INTEGER) correct, response_time_ms FROM levels JOIN models USING (model_id) WHERE intensity IN (0, 10, 30)")
def anova_frame(v):
    return v.levels.filter(F.col("intensity").isin(0, 10, 30)).join(v.models.select("model_id", "family"), "model_id").select("model_id", "family", "domain", "intensity", F.col("is_correct").cast("int").alias("correct"), "response_time_ms")


@query("a22_sensitivity", """WITH s AS (SELECT model_id, avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END) b, avg(CASE WHEN intensity > 0 THEN CAST(is_correct AS INTEGER) END) c, count(*) n FROM levels GROUP BY model_id HAVING count(*) >= 20)
SELECT model_id, round(b - c, 6) sensitivity, rank() OVER (ORDER BY round(b - c, 6) DESC) place, n FROM s""")
def sensitivity(v):
    s = v.levels.groupBy("model_id").agg(R(A.rate_where("intensity = 0") - A.rate_where("intensity > 0")).alias("sensitivity"), N().alias("n")).filter("n >= 20")
    return s.withColumn("place", F.rank().over(Window.orderBy(F.desc("sensitivity"))).cast("bigint"))


@query("a23_comparison_view", "SELECT name, family, count(DISTINCT experiment_id) experiments, round(avg(accuracy), 6) accuracy, round(avg(avg_response_time), 6) avg_time, round(sum(total_cost), 6) cost FROM metrics JOIN models USING (model_id) GROUP BY name, family")
def comparison_view(v):
    return v.metrics.join(v.models, "model_id").groupBy("name", "family").agg(F.count_distinct("experiment_id").alias("experiments"), R(F.avg("accuracy")).alias("accuracy"), R(F.avg("avg_response_time")).alias("avg_time"), R(F.sum("total_cost")).alias("cost"))


@query("a24_health", """SELECT 'responses' metric, count(*) value FROM responses UNION ALL SELECT 'models', count(DISTINCT model_id) FROM responses UNION ALL SELECT 'wrong', count(*) FROM responses WHERE NOT is_correct UNION ALL SELECT 'questions', count(*) FROM questions""")
def health(v):
    r = v.responses
    parts = [r.agg(N()), r.agg(F.count_distinct("model_id")), r.filter("not is_correct").agg(N()), v.questions.agg(N())]
    out = None
    for name, part in zip(("responses", "models", "wrong", "questions"), parts):
        row = part.toDF("value").select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionAll(row)
    return out


@query("a25_ldc_function", """SELECT experiment_id, model_id, round(greatest(0, least(1, 1 - avg(CASE WHEN intensity > 0 THEN CAST(is_correct AS INTEGER) END) / nullif(avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END), 0))), 6) ldc FROM levels GROUP BY ALL""")
def ldc_function(v):
    ldc = 1 - F.try_divide(A.rate_where("intensity > 0"), A.rate_where("intensity = 0"))
    return v.levels.groupBy("experiment_id", "model_id").agg(R(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ldc))).alias("ldc"))


@query("a82_ldc_by_family", """WITH l AS (SELECT experiment_id, model_id, greatest(0, least(1, 1 - avg(CASE WHEN intensity > 0 THEN CAST(is_correct AS INTEGER) END) / nullif(avg(CASE WHEN intensity = 0 THEN CAST(is_correct AS INTEGER) END), 0))) ldc, count(*) n FROM levels GROUP BY ALL)
SELECT family, round(sum(ldc * n) / sum(n), 6) ldc FROM l JOIN models USING (model_id) GROUP BY family""")
def ldc_by_family(v):
    ldc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(A.rate_where("intensity > 0"), A.rate_where("intensity = 0"))))
    per = v.levels.groupBy("experiment_id", "model_id").agg(ldc.alias("ldc"), N().alias("n"))
    return per.join(v.models.select("model_id", "family"), "model_id").groupBy("family").agg(R(F.sum(F.col("ldc") * F.col("n")) / F.sum("n")).alias("ldc"))


@query("a26_basic_accuracy", "SELECT count(*) total, count(*) FILTER (is_correct) correct, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy, round(avg(k), 6) mean_score, round(median(k), 6) median_score, round(stddev_samp(k), 6) sd FROM evals")
def basic_accuracy(v):
    return v.evals.agg(N().alias("total"), F.count_if("is_correct").alias("correct"), R(A.rate()).alias("accuracy"), R(F.avg("k")).alias("mean_score"), R(F.median("k")).alias("median_score"), R(F.stddev_samp("k")).alias("sd"))


@query("a27_timing", "SELECT model_id, round(avg(latency_ms), 6) mean, round(median(latency_ms), 6) median, min(latency_ms) least, max(latency_ms) most, CAST(sum(latency_ms) AS BIGINT) total, round(stddev_samp(latency_ms), 6) sd FROM evals GROUP BY model_id")
def timing(v):
    return v.evals.groupBy("model_id").agg(R(F.avg("latency_ms")).alias("mean"), R(F.median("latency_ms")).alias("median"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"), F.sum("latency_ms").alias("total"), R(F.stddev_samp("latency_ms")).alias("sd"))


@query("a28_by_difficulty", "SELECT coalesce(CAST(nullif(k % 5, 0) AS VARCHAR), 'unknown') difficulty, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy FROM evals GROUP BY ALL")
def by_difficulty(v):
    return v.evals.groupBy(F.coalesce(F.nullif(F.col("k") % 5, F.lit(0)).cast("string"), F.lit("unknown")).alias("difficulty")).agg(N().alias("n"), R(A.rate()).alias("accuracy"))


@query("a30_wald_interval", """SELECT model_id, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)), 6) low, round(least(1, p + 1.96 * sqrt(p * (1 - p) / n)), 6) high FROM (SELECT model_id, avg(CAST(is_correct AS INTEGER)) p, count(*) n FROM evals GROUP BY model_id)""")
def wald_interval(v):
    p = v.evals.groupBy("model_id").agg(A.rate().alias("p"), N().alias("n")).withColumn("e", 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    return p.select("model_id", R(F.greatest(F.lit(0.0), F.col("p") - F.col("e"))).alias("low"), R(F.least(F.lit(1.0), F.col("p") + F.col("e"))).alias("high"))


@query("a31_translation_metrics", "SELECT domain, round(avg(length(answer)), 6) avg_units, count(DISTINCT dataset) sources FROM items GROUP BY domain")
def translation_metrics(v):
    return v.items.groupBy("domain").agg(R(F.avg(F.length("answer"))).alias("avg_units"), F.count_distinct("dataset").alias("sources"))


@query("a32_document_lengths", "SELECT lang, round(avg(n_chars), 6) mean, min(n_chars) least, max(n_chars) most, round(median(n_chars), 6) median, round(stddev_samp(n_chars), 6) sd, count(*) n FROM documents GROUP BY lang")
def document_lengths(v):
    return v.raw("documents").groupBy("lang").agg(R(F.avg("n_chars")).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), R(F.median("n_chars")).alias("median"), R(F.stddev_samp("n_chars")).alias("sd"), N().alias("n"))


@query("a33_evaluator_aggregate", "SELECT transform, count(*) n, round(avg(k), 6) mean, round(stddev_pop(k), 6) sd, min(k) least, max(k) most FROM evals GROUP BY transform")
def evaluator_aggregate(v):
    return v.evals.groupBy("transform").agg(N().alias("n"), R(F.avg("k")).alias("mean"), R(F.stddev_pop("k")).alias("sd"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("a34_classification", """WITH x AS (SELECT CASE WHEN is_correct THEN transform ELSE 'scramble' END p, transform a FROM evals),
l AS (SELECT DISTINCT a AS label FROM x),
s AS (SELECT label, (SELECT count(*) FROM x WHERE p = label AND a = label) tp, (SELECT count(*) FROM x WHERE p = label) predicted, (SELECT count(*) FROM x WHERE a = label) actual FROM l)
SELECT label, tp, predicted, actual, round(coalesce(tp / nullif(predicted, 0), 0), 6) "precision", round(coalesce(tp / nullif(actual, 0), 0), 6) recall, round(coalesce(2.0 * tp / nullif(predicted + actual, 0), 0), 6) f1 FROM s""")
def classification(v):
    x = v.evals.select(F.when(F.col("is_correct"), F.col("transform")).otherwise("scramble").alias("p"), F.col("transform").alias("a"))
    return A.confusion(x, "p", "a").select("label", "tp", "predicted", "actual", *[R(c).alias(c) for c in ("precision", "recall", "f1")])


@query("a34_weighted_scores", """WITH x AS (SELECT CASE WHEN is_correct THEN transform ELSE 'scramble' END p, transform a FROM evals),
s AS (SELECT label, (SELECT count(*) FROM x WHERE p = label AND a = label) tp, (SELECT count(*) FROM x WHERE p = label) pr, (SELECT count(*) FROM x WHERE a = label) ac FROM (SELECT DISTINCT a AS label FROM x))
SELECT round(sum(ac * coalesce(tp / nullif(pr, 0), 0)) / sum(ac), 6) "precision", round(sum(tp) / sum(ac), 6) recall, round(sum(ac * coalesce(2.0 * tp / nullif(pr + ac, 0), 0)) / sum(ac), 6) f1 FROM s""")
def weighted_scores(v):
    x = v.evals.select(F.when(F.col("is_correct"), F.col("transform")).otherwise("scramble").alias("p"), F.col("transform").alias("a"))
    c = A.confusion(x, "p", "a")
    return c.agg(*[R(F.sum(F.col("actual") * F.col(m)) / F.sum("actual")).alias(m) for m in ("precision", "recall", "f1")])


@query("a37_degradation", """WITH a AS (SELECT model_id, transform, avg(CAST(is_correct AS INTEGER)) acc FROM evals GROUP BY ALL)
SELECT a.model_id, a.transform, round(b.acc - a.acc, 6) degradation, b.acc - a.acc > 0.1 AS significant FROM a JOIN a b ON a.model_id = b.model_id AND b.transform = 'original' AND a.transform <> 'original'""")
def degradation(v):
    a = v.evals.groupBy("model_id", "transform").agg(A.rate().alias("acc"))
    base = F.max(F.when(F.col("transform") == "original", F.col("acc"))).over(Window.partitionBy("model_id"))
    d = base - F.col("acc")
    return a.select("model_id", "transform", R(d).alias("degradation"), (d > 0.1).alias("significant")).filter("transform != 'original' and degradation is not null")


@query("a38_summary_by_grouping_sets", """SELECT model_id, transform, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) success, round(avg(latency_ms), 6) avg_time FROM evals GROUP BY GROUPING SETS ((model_id), (transform), ())""")
def summary_by_grouping_sets(v):
    e = v.evals
    return e.groupingSets([["model_id"], ["transform"], []], "model_id", "transform").agg(N().alias("n"), R(A.rate()).alias("success"), R(F.avg("latency_ms")).alias("avg_time"))


@query("a40_compare_experiments", "SELECT run_id, count(*) n, count(DISTINCT model_id) models, round(avg(CAST(is_correct AS INTEGER)), 6) success FROM evals GROUP BY run_id")
def compare_experiments(v):
    return v.evals.groupBy("run_id").agg(N().alias("n"), F.count_distinct("model_id").alias("models"), R(A.rate()).alias("success"))


@query("a43_performance_metrics", "SELECT * FROM metrics")
def performance_metrics(v):
    return v.metrics


@query("a46_describe", """SELECT count(latency_ms) count, round(avg(latency_ms), 6) mean, round(stddev_samp(latency_ms), 6) std, min(latency_ms) min, quantile_cont(latency_ms, .25) p25, quantile_cont(latency_ms, .5) p50, quantile_cont(latency_ms, .75) p75, max(latency_ms) max,
 (SELECT latency_ms FROM evals GROUP BY latency_ms ORDER BY count(*) DESC, latency_ms LIMIT 1) mode FROM evals""")
def describe(v):
    return A.describe(v.evals, "latency_ms").withColumns({"mean": R("mean"), "std": R("std")})


@query("a47_dataset_summary", "SELECT count(*) n, count(DISTINCT model_id) models, count(DISTINCT item_id) items, CAST(list_sort(list(DISTINCT scramble_level) FILTER (scramble_level IS NOT NULL)) AS VARCHAR) levels, round(1 - (count(*) - count(is_correct)) / count(*), 6) completion FROM evals")
def dataset_summary(v):
    text = F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.array_sort(F.collect_set("scramble_level")), lambda x: x.cast("string"))), F.lit("]"))
    return v.evals.agg(N().alias("n"), F.count_distinct("model_id").alias("models"), F.count_distinct("item_id").alias("items"), text.alias("levels"), R(1 - F.count_if(F.col("is_correct").isNull()) / N()).alias("completion"))


@query("a48_codebook", """SELECT 'model_id' AS "column", 'string' AS type, count(*) - count(model_id) nulls, count(DISTINCT model_id) uniques FROM evals UNION ALL SELECT 'scramble_level', 'double', count(*) - count(scramble_level), count(DISTINCT scramble_level) FROM evals
 UNION ALL SELECT 'latency_ms', 'bigint', count(*) - count(latency_ms), count(DISTINCT latency_ms) FROM evals""")
def codebook(v):
    return A.codebook(v.evals.select("model_id", "scramble_level", "latency_ms"))


@query("a51_percentiles", "SELECT model_id, quantile_cont(latency_ms, .25) p25, quantile_cont(latency_ms, .5) p50, quantile_cont(latency_ms, .75) p75, round(quantile_cont(latency_ms, .9), 6) p90, round(quantile_cont(latency_ms, .95), 6) p95 FROM evals GROUP BY model_id")
def percentiles(v):
    q = v.evals.groupBy("model_id").agg(F.percentile("latency_ms", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95)])).alias("q"))
    return q.select("model_id", *[R(F.col("q")[k]).alias(f"p{p}") for k, p in enumerate((25, 50, 75, 90, 95))])


@query("a52_correlation", "SELECT transform, round(corr(k, latency_ms), 6) r FROM evals GROUP BY transform")
def correlation(v):
    return v.evals.groupBy("transform").agg(R(F.corr("k", "latency_ms")).alias("r"))


@query("a53_outliers", """WITH q AS (SELECT model_id, quantile_cont(latency_ms, .25) a, quantile_cont(latency_ms, .75) b FROM evals GROUP BY model_id)
SELECT eval_id, model_id, latency_ms FROM evals JOIN q USING (model_id) WHERE latency_ms < a - 1.5 * (b - a) OR latency_ms > b + 1.5 * (b - a)""")
def outliers(v):
    q = v.evals.groupBy("model_id").agg(F.percentile("latency_ms", 0.25).alias("a"), F.percentile("latency_ms", 0.75).alias("b"))
    return v.evals.join(q, "model_id").filter("latency_ms < a - 1.5 * (b - a) or latency_ms > b + 1.5 * (b - a)").select("eval_id", "model_id", "latency_ms")


@query("a54_benchmark_difficulty", "SELECT dataset, round(1 - avg(CAST(is_correct AS INTEGER)), 6) difficulty, count(*) n FROM evals JOIN items USING (item_id) GROUP BY dataset")
def benchmark_difficulty(v):
    return v.evals.join(v.items.select("item_id", "dataset"), "item_id").groupBy("dataset").agg(R(1 - A.rate()).alias("difficulty"), N().alias("n"))


@query("a56_families_across_runs", "SELECT model_family, round(avg(CASE WHEN run_id = 'run_a' THEN CAST(is_correct AS INTEGER) END), 6) run_a, round(avg(CASE WHEN run_id = 'run_b' THEN CAST(is_correct AS INTEGER) END), 6) run_b FROM evals GROUP BY model_family")
def families_across_runs(v):
    return v.evals.groupBy("model_family").pivot("run_id", ["run_a", "run_b"]).agg(R(A.rate()))


@query("a59_eta", """WITH n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) back, count(*) OVER (PARTITION BY user_id) done FROM events),
l AS (SELECT user_id, count(*) - 1 steps, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, max(done) done FROM n WHERE back <= 10 GROUP BY user_id)
SELECT user_id, steps, seconds, (SELECT max(done) FROM l) - done AS remaining, round(((SELECT max(done) FROM l) - done) * seconds / CAST(nullif(steps, 0) AS DOUBLE), 3) eta_seconds FROM l""")
def eta(v):
    """Pace of each user's last ten events, and how long at this pace until the user has as many as the busiest one. Ranks past ten go before the shuffle."""
    e = v.raw("events").select("user_id", "ts", "event_id")
    last = e.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("back <= 10")
    pace = last.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("steps"), F.expr("unix_seconds(cast(max(ts) as timestamp)) - unix_seconds(cast(min(ts) as timestamp))").alias("seconds"))
    done = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("_done"))
    remaining = done.agg(F.max("_done").alias("_most")).scalar() - F.col("_done")
    all_ = pace.join(done.withColumnRenamed("user_id", "_user"), F.col("user_id").eqNullSafe(F.col("_user"))).select("user_id", "steps", "seconds", remaining.alias("remaining"))
    return all_.withColumn("eta_seconds", F.round(F.try_divide(F.col("remaining") * F.col("seconds"), F.col("steps").cast("double")), 3))


#: Prices of a million tokens by model; models that are not listed cost DEFAULT_PRICE.
MODEL_PRICES, DEFAULT_PRICE = {"m0": 0.5, "m1": 1.0, "m2": 2.0}, 2.0


@query("a61_cost_projection", f"""SELECT e.model_id, transform, dataset, CAST(sum(greatest(1, length(question) // 4)) AS BIGINT) tokens, round(sum(greatest(1, length(question) // 4)) * CASE e.model_id {' '.join(f"WHEN '{m}' THEN {p}" for m, p in MODEL_PRICES.items())} ELSE {DEFAULT_PRICE} END / 1e6, 6) cost
 FROM evals e JOIN items USING (item_id) GROUP BY e.model_id, transform, dataset""")
def cost_projection(v):
    """All models, transforms and datasets, at the listed price or the default one."""
    price, _ = score.price(F.col("model_id"), MODEL_PRICES, DEFAULT_PRICE)
    tokens = F.sum(F.greatest(F.lit(1), F.floor(F.length("question") / 4)))
    asked = v.evals.join(v.items.select("item_id", "question", "dataset"), "item_id").groupBy("model_id", "transform", "dataset").agg(tokens.alias("tokens"))
    return asked.select("model_id", "transform", "dataset", "tokens", R(F.col("tokens") * price / 1e6).alias("cost"))


@query("a68_contamination_frame", """SELECT model_id, domain, round(avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END), 6) acc_original, round(avg(CASE WHEN transform = 'paraphrase' THEN CAST(is_correct AS INTEGER) END), 6) acc_paraphrase,
 round(avg(CASE WHEN scramble_level = 0.3 THEN CAST(is_correct AS INTEGER) END), 6) acc_scrambled, round(avg(tok_kl), 6) tok_kl, round(avg(tok_frag), 6) tok_frag FROM evals2 JOIN items USING (item_id) GROUP BY model_id, domain""")
def contamination_frame(v):
    j = v.evals.join(v.items.select("item_id", "domain"), "item_id")
    return j.groupBy("model_id", "domain").agg(R(A.rate_where("transform = 'original'")).alias("acc_original"), R(A.rate_where("transform = 'paraphrase'")).alias("acc_paraphrase"), R(A.rate_where("scramble_level = 0.3")).alias("acc_scrambled"), R(F.avg("tok_kl")).alias("tok_kl"), R(F.avg("tok_frag")).alias("tok_frag"))


@query("a69_contamination_by_model", """SELECT model_id, round(avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END) - avg(CASE WHEN transform = 'paraphrase' THEN CAST(is_correct AS INTEGER) END), 6) delta_paraphrase,
 round(avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END) - avg(CASE WHEN transform = 'scramble' THEN CAST(is_correct AS INTEGER) END), 6) delta_scramble FROM evals GROUP BY model_id""")
def contamination_by_model(v):
    base = A.rate_where("transform = 'original'")
    return v.evals.groupBy("model_id").agg(R(base - A.rate_where("transform = 'paraphrase'")).alias("delta_paraphrase"), R(base - A.rate_where("transform = 'scramble'")).alias("delta_scramble"))


@query("a72_nearest_to_sizes", "SELECT t target, arg_min(model_id, abs(n_params / 1e9 - t) + CAST(substr(model_id, 2) AS INTEGER) * 1e-9) model_id FROM models, (VALUES (2.0), (9.0), (27.0), (70.0)) x(t) GROUP BY t")
def nearest_to_sizes(v):
    sizes = v.spark.sql("SELECT CAST(target AS DOUBLE) AS target FROM VALUES (2.0), (9.0), (27.0), (70.0) AS t(target)")
    return v.models.crossJoin(F.broadcast(sizes)).groupBy("target").agg(F.min_by("model_id", F.struct(F.abs(F.col("n_params") / 1e9 - F.col("target")), "model_id")).alias("model_id"))


@query("a73_pivot_by_level", "SELECT model_id, " + ", ".join(f"round(avg(CASE WHEN scramble_level = {x} THEN tok_kl END), 6) AS \"{x}\"" for x in (0.1, 0.3, 0.5)) + " FROM evals2 WHERE scramble_level IS NOT NULL GROUP BY model_id")
def pivot_by_level(v):
    return v.evals.filter("scramble_level is not null").groupBy("model_id").pivot("scramble_level", [0.1, 0.3, 0.5]).agg(R(F.avg("tok_kl")))


@query("a74_heatmap", "SELECT model_id, " + ", ".join(f"round(coalesce(avg(CASE WHEN transform = '{t}' THEN CAST(is_correct AS INTEGER) END), 0), 6) AS {t}" for t in ("original", "paraphrase", "scramble")) + " FROM evals GROUP BY model_id")
def heatmap(v):
    return v.evals.groupBy("model_id").pivot("transform", ["original", "paraphrase", "scramble"]).agg(R(A.rate())).fillna(0.0)


@query("a75_histogram", """WITH e AS (SELECT min(latency_ms) lo, max(latency_ms) hi FROM evals) SELECT CAST(least(29, floor((latency_ms - lo) * 30 / nullif(CAST(hi - lo AS DOUBLE), 0))) AS BIGINT) bin, count(*) n FROM evals, e GROUP BY 1""")
def histogram(v):
    return A.histogram(v.evals, "latency_ms", 30)


@query("a77_contamination_verdict", """SELECT model_id, round(s, 6) score, CASE WHEN s < 0.6 THEN 'high' WHEN s < 0.8 THEN 'moderate' ELSE 'low' END risk FROM
 (SELECT model_id, avg(CASE WHEN transform = 'scramble' THEN CAST(is_correct AS INTEGER) END) / nullif(avg(CASE WHEN transform = 'original' THEN CAST(is_correct AS INTEGER) END), 0) s FROM evals GROUP BY model_id)""")
def contamination_verdict(v):
    s = v.evals.groupBy("model_id").agg(F.try_divide(A.rate_where("transform = 'scramble'"), A.rate_where("transform = 'original'")).alias("s"))
    return s.select("model_id", R("s").alias("score"), F.when(F.col("s") < 0.6, "high").when(F.col("s") < 0.8, "moderate").otherwise("low").alias("risk"))


@query("a83_row_count", "SELECT count(*) n FROM evals")
def row_count(v):
    return v.evals.agg(N().alias("n"))


@query("a88_running_totals", """SELECT eval_id, model_id, count(*) OVER w calls, round(sum(cost_usd) OVER w, 6) cost, round(avg(CAST(is_correct AS INTEGER)) OVER w, 6) success FROM evals WINDOW w AS (PARTITION BY model_id ORDER BY timestamp, eval_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(v):
    rows = v.evals.select("eval_id", "model_id", "timestamp", "cost_usd", "is_correct")
    sums = {"calls": F.lit(1).cast("bigint"), "cost": F.col("cost_usd"), "correct": F.col("is_correct").cast("bigint"), "judged": F.col("is_correct").isNotNull().cast("bigint")}
    run = W.running_totals(rows, "model_id", F.date_trunc("hour", "timestamp"), ["timestamp", "eval_id"], sums)
    return run.select("eval_id", "model_id", "calls", R("cost").alias("cost"), R(F.try_divide("correct", "judged")).alias("success"))
