"""Filters, projections, joins, windows, set operations and validators (inventory PF, J, W, S, U, V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import joins as J
from larkspur.operators import validate as V
from larkspur.operators import windows as W
from larkspur.plans.candidates import CANDIDATES, candidates
from larkspur.registry import query

R = lambda c: F.round(c, 6)


@query("pf1_filter_evals", "SELECT eval_id, model_id, latency_ms FROM evals WHERE run_id = 'run_a' AND model_id = 'm1' AND transform = 'original'")
def filter_evals(v):
    out = v.evals
    for column, value in {"run_id": "run_a", "model_id": "m1", "transform": "original", "item_id": None}.items():
        out = out if value is None else out.filter(F.col(column) == value)
    return out.select("eval_id", "model_id", "latency_ms")


@query("pf2_filter_items", "SELECT item_id, dataset, domain FROM items WHERE domain = 'en' AND dataset IN ('src1', 'src2')")
def filter_items(v):
    return v.items.filter((F.col("domain") == "en") & F.col("dataset").isin("src1", "src2")).select("item_id", "dataset", "domain")


@query("pf3_search", "SELECT item_id FROM items WHERE contains(question, 'the') ORDER BY item_id LIMIT 10")
def search(v):
    return v.items.filter(F.contains("question", F.lit("the"))).select("item_id").orderBy("item_id").limit(10)


@query("pf4_exists", "SELECT EXISTS (SELECT 1 FROM evals WHERE model_id = 'm3' AND NOT is_correct) AS found")
def exists(v):
    return v.evals.filter("model_id = 'm3' and not is_correct").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("pf5_by_id", "SELECT eval_id, item_id, is_correct FROM evals WHERE eval_id = 'e17'")
def by_id(v):
    return v.evals.filter("eval_id = 'e17'").select("eval_id", "item_id", "is_correct")


@query("pf6_high_quality_candidates", CANDIDATES + "SELECT item_id, candidate_id, cos_sim, edit_ratio FROM candidates WHERE cos_sim >= 0.85 AND edit_ratio >= 0.25 AND accepted ORDER BY cos_sim DESC, item_id, candidate_id")
def high_quality(v):
    return candidates(v).filter("cos_sim >= 0.85 and edit_ratio >= 0.25 and accepted").select("item_id", "candidate_id", "cos_sim", "edit_ratio").orderBy(F.desc("cos_sim"), "item_id", "candidate_id")


@query("pf7_null_in_between", "SELECT eval_id FROM evals WHERE scramble_level IS NOT NULL AND model_id IN ('m0', 'm7') AND latency_ms BETWEEN 100 AND 500")
def null_in_between(v):
    return v.evals.filter(F.col("scramble_level").isNotNull() & F.col("model_id").isin("m0", "m7") & F.col("latency_ms").between(100, 500)).select("eval_id")


@query("pf8_robustness_bucket", "SELECT experiment_id, model_id, CASE WHEN threshold_intensity >= 75 OR threshold_intensity IS NULL THEN 'robust' WHEN threshold_intensity >= 50 THEN 'moderate' WHEN threshold_intensity >= 25 THEN 'weak' ELSE 'fragile' END bucket FROM thresholds")
def robustness_bucket(v):
    t = F.col("threshold_intensity")
    return v.thresholds.select("experiment_id", "model_id", F.when((t >= 75) | t.isNull(), "robust").when(t >= 50, "moderate").when(t >= 25, "weak").otherwise("fragile").alias("bucket"))


@query("pf9_scrambling_category", "SELECT CASE WHEN intensity = 0 THEN 'baseline' WHEN intensity <= 20 THEN 'low' WHEN intensity <= 40 THEN 'medium' WHEN intensity <= 60 THEN 'high' ELSE 'extreme' END category, count(*) n FROM levels GROUP BY ALL")
def scrambling_category(v):
    i = F.col("intensity")
    return v.levels.groupBy(F.when(i == 0, "baseline").when(i <= 20, "low").when(i <= 40, "medium").when(i <= 60, "high").otherwise("extreme").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("pf11_quality_score", CANDIDATES + "SELECT item_id, candidate_id, round(CASE WHEN cos_sim <> 0 AND edit_ratio <> 0 THEN 0.7 * cos_sim + 0.3 * (1 - edit_ratio) END, 8) quality, cos_sim >= 0.85 AND edit_ratio >= 0.25 AS meets FROM candidates")
def quality_score(v):
    score = F.when((F.col("cos_sim") != 0) & (F.col("edit_ratio") != 0), 0.7 * F.col("cos_sim") + 0.3 * (1 - F.col("edit_ratio")))
    return candidates(v).select("item_id", "candidate_id", F.round(score, 8).alias("quality"), ((F.col("cos_sim") >= 0.85) & (F.col("edit_ratio") >= 0.25)).alias("meets"))


@query("pf12_derived", "SELECT eval_id, round(CASE WHEN k <> 0 AND latency_ms <> 0 THEN k * 1000.0 / latency_ms END, 6) tokens_per_second, round(100.0 * k / 200, 6) progress FROM evals")
def derived(v):
    return v.evals.select("eval_id", R(F.when((F.col("k") != 0) & (F.col("latency_ms") != 0), F.col("k") * 1000.0 / F.col("latency_ms"))).alias("tokens_per_second"), R(100.0 * F.col("k") / 200).alias("progress"))


@query("pf13_json_field", "SELECT event_id, json_extract_string(props, '$.k') k FROM events")
def json_field(v):
    return v.raw("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("pf14_analysis_frame", """SELECT eval_id, CASE WHEN transform = 'scramble' THEN 'scramble_' || scramble_level ELSE transform END condition, round(log10(n_params), 6) log_n, round(tok_kl, 6) tok_kl, round(tok_frag, 6) tok_frag, coalesce(scramble_level, 0) intensity FROM evals2""")
def analysis_frame(v):
    label = F.when(F.col("transform") == "scramble", F.concat(F.lit("scramble_"), F.col("scramble_level").cast("string"))).otherwise(F.col("transform"))
    return v.evals.select("eval_id", label.alias("condition"), R(F.log10("n_params")).alias("log_n"), R("tok_kl").alias("tok_kl"), R("tok_frag").alias("tok_frag"), F.coalesce("scramble_level", F.lit(0.0)).alias("intensity"))


@query("pf16_export_cleaning", "SELECT eval_id, CAST(is_correct AS INTEGER) is_correct, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, coalesce(scramble_level, 0) scramble_level, coalesce(model_family, '') model_family FROM evals")
def export_cleaning(v):
    from larkspur.sources.export import cleaned

    return cleaned(v.evals.select("eval_id", "is_correct", "timestamp", "scramble_level", "model_family"))


@query("pf19_retention", "SELECT event_id FROM events WHERE NOT (ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND event_type IN ('error', 'view'))")
def retention(v):
    e = v.raw("events")
    newest = e.agg(F.max("ts").alias("now"))
    old = (F.col("ts") < F.col("now") - F.expr("INTERVAL 10 DAYS")) & F.col("event_type").isin("error", "view")
    return e.crossJoin(F.broadcast(newest)).filter(~old).select("event_id")


@query("pf21_size_class", "SELECT model_id, CASE WHEN contains(x, '270m') THEN 0.27 WHEN contains(x, '8x22b') THEN 141 WHEN contains(x, '70b') THEN 70 WHEN contains(x, '9b') THEN 9 WHEN contains(x, '2b') THEN 2 ELSE 10 END::DOUBLE billions FROM (SELECT model_id, list_extract(['a-270m', 'b-1b', 'c-2b', 'd-4b', 'e-9b', 'f-8x22b', 'g-27b', 'h-70b'], CAST(substr(model_id, 2) AS INTEGER) + 1) x FROM models)")
def size_class(v):
    names = F.array(*[F.lit(x) for x in ("a-270m", "b-1b", "c-2b", "d-4b", "e-9b", "f-8x22b", "g-27b", "h-70b")])
    x = F.get(names, F.substring("model_id", 2, 3).cast("int"))
    out = None
    for part, size in (("270m", 0.27), ("8x22b", 141.0), ("70b", 70.0), ("9b", 9.0), ("2b", 2.0)):
        out = F.when(x.contains(part), F.lit(size)) if out is None else out.when(x.contains(part), F.lit(size))
    return v.models.select("model_id", out.otherwise(10.0).alias("billions"))


@query("pf22_display", "SELECT model_id, CASE WHEN n_params >= 1e9 THEN printf('%.1fB', n_params / 1e9) ELSE printf('%.1fM', n_params / 1e6) END label FROM models")
def display(v):
    return v.models.select("model_id", F.when(F.col("n_params") >= 1e9, F.format_string("%.1fB", F.col("n_params") / 1e9)).otherwise(F.format_string("%.1fM", F.col("n_params") / 1e6)).alias("label"))


@query("pf23_view_consumers", "SELECT model_id, intensity, accuracy FROM metrics WHERE experiment_id = 'x_run_a' AND method = 'character'")
def view_consumers(v):
    return v.metrics.filter("experiment_id = 'x_run_a' and method = 'character'").select("model_id", "intensity", "accuracy")


@query("pf25_lifecycle_update", "SELECT experiment_id, CASE WHEN experiment_id = 'x_run_b' THEN 'completed' ELSE status END status FROM experiments WHERE experiment_id <> 'none'")
def lifecycle_update(v):
    from larkspur.sources.store import deleted, updated

    return deleted(updated(v.experiments, F.col("experiment_id") == "x_run_b", {"status": F.lit("completed")}), F.col("experiment_id") == "none").select("experiment_id", "status")


@query("pf26_cascade_delete", "SELECT response_id FROM responses WHERE experiment_id NOT IN (SELECT experiment_id FROM experiments WHERE status = 'running')")
def cascade_delete(v):
    return v.responses.join(v.experiments.filter("status = 'running'"), "experiment_id", "left_anti").select("response_id")


@query("pf28_recommendations", """WITH a AS (SELECT model_id, avg(CAST(is_correct AS INTEGER)) acc, avg(latency_ms) t, count(*) n FROM evals GROUP BY model_id)
SELECT model_id, array_to_string(list_filter([CASE WHEN acc < 0.5 THEN 'low accuracy' END, CASE WHEN t > 400 THEN 'slow' END, CASE WHEN n < 100 THEN 'few rows' END], lambda x: x IS NOT NULL), '; ') advice FROM a""")
def recommendations(v):
    a = v.evals.groupBy("model_id").agg(F.avg(F.col("is_correct").cast("int")).alias("acc"), F.avg("latency_ms").alias("t"), F.count(F.lit(1)).alias("n"))
    return a.select("model_id", F.concat_ws("; ", F.when(F.col("acc") < 0.5, "low accuracy"), F.when(F.col("t") > 400, "slow"), F.when(F.col("n") < 100, "few rows")).alias("advice"))


@query("j1_evals_items", "SELECT eval_id, dataset, domain FROM evals JOIN items USING (item_id)")
def evals_items(v):
    return v.evals.select("eval_id", "item_id").join(v.items.select("item_id", "dataset", "domain"), "item_id").select("eval_id", "dataset", "domain")


@query("j2_threshold_report", "SELECT e.experiment_name, m.name, m.family, t.threshold_intensity, t.ldc FROM thresholds t JOIN models m USING (model_id) JOIN experiments e USING (experiment_id)")
def threshold_report(v):
    return v.thresholds.join(v.models, "model_id").join(v.experiments, "experiment_id").select("experiment_name", "name", "family", "threshold_intensity", "ldc")


@query("j3_performance_curves", "SELECT e.experiment_name, m.name, intensity, accuracy, ci_low, ci_high FROM metrics JOIN models m USING (model_id) JOIN experiments e USING (experiment_id)")
def performance_curves(v):
    return v.metrics.join(v.models, "model_id").join(v.experiments, "experiment_id").select("experiment_name", "name", "intensity", "accuracy", "ci_low", "ci_high")


@query("j4_composite_key", "SELECT experiment_id, model_id, intensity, accuracy, ldc FROM metrics JOIN thresholds USING (experiment_id, model_id)")
def composite_key(v):
    return v.metrics.join(v.thresholds, ["experiment_id", "model_id"]).select("experiment_id", "model_id", "intensity", "accuracy", "ldc")


@query("j5_left_outer", "SELECT r.response_id, coalesce(q.question_id, s.original_question_id) question_id, s.intensity FROM responses r LEFT JOIN questions q ON r.original_question_id = q.question_id LEFT JOIN scrambled s ON r.scrambled_question_id = s.scrambled_question_id")
def left_outer(v):
    q = v.questions.select(F.col("question_id").alias("original_question_id"), F.lit(True).alias("hit"))
    s = v.scrambled.select("scrambled_question_id", F.col("original_question_id").alias("base"), "intensity")
    j = v.responses.join(q, "original_question_id", "left").join(s, "scrambled_question_id", "left")
    return j.select("response_id", F.coalesce(F.when(F.col("hit"), F.col("original_question_id")), "base").alias("question_id"), "intensity")


@query("j6_resolved_questions", "SELECT response_id, question_id, intensity, domain FROM levels")
def resolved_questions(v):
    return v.levels.select("response_id", "question_id", "intensity", "domain")


@query("j8_model_pairs", "SELECT a.model_id a, b.model_id b FROM models a JOIN models b ON a.model_id < b.model_id")
def model_pairs(v):
    return J.unordered_pairs(v.models, "model_id")


@query("j9_aligned_pairs", """WITH s AS (SELECT model_id, item_id, avg(CAST(is_correct AS INTEGER)) v FROM evals GROUP BY ALL)
SELECT a.model_id a, b.model_id b, count(*) n, round(avg(a.v - b.v), 6) difference FROM s a JOIN s b ON a.item_id = b.item_id AND a.model_id <> b.model_id GROUP BY ALL""")
def aligned_pairs(v):
    s = v.evals.groupBy("model_id", "item_id").agg(F.avg(F.col("is_correct").cast("int")).alias("v"))
    return J.aligned_pairs(s, "model_id", "item_id", "v").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.col("value_a") - F.col("value_b"))).alias("difference"))


@query("j12_missing_paraphrases", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM evals WHERE transform = 'paraphrase')")
def missing_paraphrases(v):
    return v.items.select("item_id").join(v.evals.filter("transform = 'paraphrase'"), "item_id", "left_anti")


@query("j13_overlap", "SELECT DISTINCT model_id FROM evals WHERE run_id = 'run_a' INTERSECT SELECT DISTINCT model_id FROM evals WHERE run_id = 'run_b'")
def overlap(v):
    return v.evals.filter("run_id = 'run_a'").select("model_id").distinct().join(v.evals.filter("run_id = 'run_b'"), "model_id", "left_semi")


@query("j14_tasks", "SELECT model_id, t transform, item_id FROM models, (VALUES ('original'), ('paraphrase'), ('scramble_0.1'), ('scramble_0.3')) x(t), items")
def tasks(v):
    transforms = F.explode(F.concat(F.array(F.lit("original"), F.lit("paraphrase")), F.transform(F.array(F.lit("0.1"), F.lit("0.3")), lambda x: F.concat(F.lit("scramble_"), x))))
    return v.items.select("item_id").crossJoin(F.broadcast(v.models.select("model_id"))).select("model_id", transforms.alias("transform"), "item_id")


@query("j16_level_join", """WITH a AS (SELECT model_id, scramble_level, avg(CAST(is_correct AS INTEGER)) acc FROM evals WHERE scramble_level IS NOT NULL GROUP BY ALL), b AS (SELECT model_id, scramble_level, avg(tok_kl) kl FROM evals2 GROUP BY ALL)
SELECT model_id, scramble_level, round(acc, 6) acc, round(kl, 6) kl FROM a JOIN b USING (model_id, scramble_level)""")
def level_join(v):
    keys = ["model_id", "scramble_level"]
    scrambled = v.evals.filter("scramble_level is not null")
    accuracy = scrambled.groupBy(*keys).agg(R(F.avg(F.col("is_correct").cast("int"))).alias("acc"))
    tokens = scrambled.groupBy(*keys).agg(R(F.avg("tok_kl")).alias("kl"))
    return accuracy.join(tokens, keys)


@query("w2_ranked_families", "SELECT model_family, domain, rank() OVER (PARTITION BY domain ORDER BY acc DESC) AS place, acc FROM (SELECT model_family, domain, round(avg(CAST(is_correct AS INTEGER)), 6) acc FROM evals JOIN items USING (item_id) GROUP BY ALL)")
def ranked_families(v):
    a = v.evals.join(v.items.select("item_id", "domain"), "item_id").groupBy("model_family", "domain").agg(R(F.avg(F.col("is_correct").cast("int"))).alias("acc"))
    return a.withColumn("place", F.rank().over(Window.partitionBy("domain").orderBy(F.desc("acc"))).cast("bigint"))


@query("w4_best_candidate", CANDIDATES + "SELECT item_id, candidate_id, cos_sim FROM candidates WHERE accepted QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cos_sim DESC, candidate_id) = 1")
def best_candidate(v):
    return W.latest(candidates(v).filter("accepted").select("item_id", "candidate_id", "cos_sim"), ["item_id"], F.desc("cos_sim"), F.col("candidate_id"))


@query("w7_bounded_history", "SELECT eval_id, model_id FROM (SELECT eval_id, model_id, row_number() OVER (PARTITION BY model_id ORDER BY timestamp DESC, eval_id) n FROM evals) WHERE n <= 10")
def bounded_history(v):
    return v.evals.withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("timestamp"), "eval_id"))).filter("n <= 10").select("eval_id", "model_id")


@query("w8_stratified_sample", """WITH s AS (SELECT domain, row_number() OVER (ORDER BY domain) k, count(*) OVER () m FROM (SELECT DISTINCT domain FROM items))
SELECT item_id, domain FROM (SELECT item_id, domain, k, m, row_number() OVER (PARTITION BY domain ORDER BY md5('7' || item_id), item_id) n FROM items JOIN s USING (domain)) WHERE n <= 30 // m + CASE WHEN k <= 30 % m THEN 1 ELSE 0 END""")
def stratified_sample(v):
    return W.stratified(v.items.select("item_id", "domain"), "domain", "item_id", 30, "7")


@query("w9_head_per_dataset", "SELECT item_id, dataset FROM (SELECT item_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY item_id) n FROM items) WHERE n <= 3")
def head_per_dataset(v):
    return v.items.withColumn("n", F.row_number().over(Window.partitionBy("dataset").orderBy("item_id"))).filter("n <= 3").select("item_id", "dataset")


@query("s3_paging", "SELECT eval_id, timestamp FROM evals ORDER BY timestamp, eval_id LIMIT 20 OFFSET 40")
def paging(v):
    return v.evals.select("eval_id", "timestamp").orderBy("timestamp", "eval_id").offset(40).limit(20)


@query("s4_model_ranking", "SELECT model_id, round(avg(k), 6) score, row_number() OVER (ORDER BY round(avg(k), 6) DESC, model_id) AS place FROM evals GROUP BY model_id")
def model_ranking(v):
    s = v.evals.groupBy("model_id").agg(R(F.avg("k")).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "model_id")).cast("bigint"))


@query("u1_union_all", "SELECT item_id AS id FROM items UNION ALL SELECT model_id FROM models")
def union_all(v):
    return v.items.select(F.col("item_id").alias("id")).unionAll(v.models.select("model_id"))


@query("u2_set_operations", """WITH a AS (SELECT item_id FROM evals WHERE is_correct AND model_id IN ('m0', 'm1')), b AS (SELECT item_id FROM evals WHERE is_correct AND model_id IN ('m1', 'm2')),
x AS (SELECT item_id FROM a UNION SELECT item_id FROM b), y AS (SELECT item_id FROM a INTERSECT SELECT item_id FROM b), z AS (SELECT item_id FROM a EXCEPT SELECT item_id FROM b)
SELECT 'union' AS operation, item_id FROM x UNION ALL SELECT 'intersection', item_id FROM y UNION ALL SELECT 'difference', item_id FROM z""")
def set_operations(v):
    """Items that two overlapping sets of models answer correctly: by either, by both, by the first only."""
    a, b = (v.evals.filter(F.col("is_correct") & F.col("model_id").isin(*models)).select("item_id") for models in (("m0", "m1"), ("m1", "m2")))
    named = lambda name, df: df.select(F.lit(name).alias("operation"), "item_id")
    return named("union", a.union(b).distinct()).union(named("intersection", a.intersect(b))).union(named("difference", a.subtract(b)))


@query("u3_distinct", "SELECT DISTINCT dataset, domain FROM items")
def distinct(v):
    return v.items.select("dataset", "domain").distinct()


@query("u4_row_dedup", "SELECT DISTINCT text FROM documents")
def row_dedup(v):
    return v.raw("documents").select("text").dropDuplicates()


@query("v2_response_checks", "SELECT * FROM (SELECT response_id, response_time_ms NOT BETWEEN 1 AND 600000 AS bad_time, token_count > 2 * length(question) AS many_tokens, token_count < length(question) // 10 AS few_tokens FROM responses JOIN questions ON question_id = coalesce(original_question_id, regexp_replace(scrambled_question_id, '_[0-9]+$', ''))) WHERE bad_time OR many_tokens OR few_tokens")
def response_checks(v):
    """Tokens are counted against the length of the question: at most twice as many, at least a tenth."""
    asked = F.coalesce("original_question_id", F.regexp_replace("scrambled_question_id", "_[0-9]+$", ""))
    both = v.responses.join(v.questions.select("question_id", F.length("question").alias("long")), asked == F.col("question_id"))
    bad, tokens = ~F.col("response_time_ms").between(1, 600000), F.col("token_count")
    told = both.select("response_id", bad.alias("bad_time"), (tokens > 2 * F.col("long")).alias("many_tokens"), (tokens < F.floor(F.col("long") / 10)).alias("few_tokens"))
    return told.filter("bad_time or many_tokens or few_tokens")


@query("v4_constraints", """SELECT 'unique eval_id' AS rule, (SELECT count(*) FROM (SELECT eval_id FROM evals GROUP BY eval_id HAVING count(*) > 1)) violations UNION ALL
SELECT 'item exists', (SELECT count(*) FROM evals WHERE item_id NOT IN (SELECT item_id FROM items)) UNION ALL SELECT 'one question', (SELECT count(*) FROM responses WHERE (original_question_id IS NULL) = (scrambled_question_id IS NULL))""")
def constraints(v):
    one = F.col("original_question_id").isNull() == F.col("scrambled_question_id").isNull()
    return V.report({"unique eval_id": V.duplicates(v.evals, ["eval_id"]), "item exists": V.orphans(v.evals, v.items, "item_id"), "one question": v.responses.filter(one)})


@query("v4_check_rules", "SELECT 'positive latency' AS rule, count(*) FILTER (NOT latency_ms > 0) violations FROM evals UNION ALL SELECT 'known transform', count(*) FILTER (transform NOT IN ('original', 'scramble')) FROM evals")
def check_rules(v):
    return V.violations(v.evals, {"positive latency": "latency_ms > 0", "known transform": "transform in ('original', 'scramble')"})


@query("x6_alerts", "SELECT event_id, user_id, value FROM events WHERE value > (CASE event_type WHEN 'error' THEN 85 WHEN 'view' THEN 90 ELSE 95 END)")
def alerts(v):
    limit = F.when(F.col("event_type") == "error", 85).when(F.col("event_type") == "view", 90).otherwise(95)
    return v.raw("events").filter(F.col("value") > limit).select("event_id", "user_id", "value")
