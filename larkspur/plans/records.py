"""Records and their evaluation: fields, evaluators, filters, summary views, runs and budgets (inventory F, PF, A, V, X)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.functions import score as S
from larkspur.functions import evaluators, extract
from larkspur.functions.responder import answered
from larkspur.operators.aggregates import rate_where
from larkspur.registry import query

R = lambda c: F.round(c, 6)


@query("f18_problem_text", "SELECT doc_id, md5(coalesce(CASE WHEN lang = 'en' THEN text END, CASE WHEN lang = 'de' THEN text END, concat_ws(' ', source, lang))) problem FROM documents")
def problem_text(v):
    """English texts are questions, German ones prompts; other records have neither."""
    d = v.raw("documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("question"), F.when(F.col("lang") == "de", F.col("text")).alias("prompt"), "source", "lang")
    return d.select("doc_id", F.md5(extract.problem_text(d)).alias("problem"))


@query("f19_answer", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR), 'unknown') answer FROM documents LEFT JOIN labels USING (doc_id)")
def answer(v):
    d = v.raw("documents").select("doc_id").join(v.raw("labels").select("doc_id", F.col("quality").alias("target"), F.col("toxic").alias("label")), "doc_id", "left")
    return d.select("doc_id", extract.answer_text(d).alias("answer"))


@query("f35_nested_text", "SELECT doc_id, md5(concat_ws(' ', text, lang, source, lang, source)) words FROM documents")
def nested_text(v):
    problem = F.struct(F.col("text"), F.col("n_chars"), F.struct("lang", F.array(F.struct("source"), F.struct(F.col("lang").alias("source"))).alias("parts")).alias("about"), F.create_map(F.lit("s"), F.col("source")).alias("tags"))
    d = v.raw("documents").select("doc_id", problem.alias("problem"))
    return d.select("doc_id", F.md5(extract.nested_text(F.col("problem"), d.schema["problem"].dataType)).alias("words"))


@query("f4_semantic")
def semantic(v):
    """No SQL: no function of DuckDB finds matching blocks."""
    return v.qa_pairs.select("conv_id", "turn", evaluators.evaluated("semantic", F.col("predicted"), F.col("question")).alias("correct"))


@query("f5_custom_evaluator", r"SELECT conv_id, turn, 4 * len(list_intersect(p, e)) >= len(e) AS correct FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(predicted), '\s+'), lambda w: w <> '')) p, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: w <> '')) e FROM qa_pairs)")
def custom_evaluator(v):
    """Right where the answer has a quarter of the expected text's words or more."""
    own = lambda c: F.array_distinct(S.tokens(c))
    evaluators.register_evaluator("quarter_of_words", lambda p, e: 4 * F.size(F.array_intersect(own(p), own(e))) >= F.size(own(e)))
    return v.qa_pairs.select("conv_id", "turn", evaluators.evaluated("quarter_of_words", F.col("predicted"), F.col("question")).alias("correct"))


def filtered(df, model: str | None = None, transform: str | None = None, correct: bool | None = None):
    """Evaluations of a model, a transform and an outcome; None takes all."""
    for column, value in (("model_id", model), ("transform", transform), ("is_correct", correct)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


@query("pf17_filters", "SELECT eval_id, model_id, transform, is_correct FROM evals WHERE model_id = 'm1' AND transform = 'scramble' AND NOT is_correct UNION ALL SELECT eval_id, model_id, transform, is_correct FROM evals WHERE transform = 'paraphrase' AND is_correct")
def filters(v):
    both = filtered(v.evals, "m1", "scramble", False).unionAll(filtered(v.evals, transform="paraphrase", correct=True))
    return both.select("eval_id", "model_id", "transform", "is_correct")


CONFIDENCE = r"""CASE WHEN NOT contains(question, ',') AND NOT contains(question, ';') AND len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: w <> '')) > 10 THEN 0.9 WHEN contains(lower(predicted), lower(question)) THEN 1.0 ELSE 0.35 END"""
KIND = "CASE WHEN length(predicted) = 0 THEN 'empty' WHEN length(predicted) - length(replace(predicted, ' ', '')) < 10 THEN 'short' ELSE 'long' END"


def transformed_pairs(v):
    from larkspur.plans.languages import confidence_of

    blanks = F.length("predicted") - F.length(F.replace("predicted", F.lit(" "), F.lit("")))
    kind = F.when(F.length("predicted") == 0, "empty").when(blanks < 10, "short").otherwise("long")
    return v.qa_pairs.select(confidence_of("question", "predicted").alias("confidence"), kind.alias("kind"))


@query("a66_qa_stats", f"SELECT count(*) total, round(avg(c), 6) mean, min(c) least, max(c) most, CAST(count_if(c < 0.7) AS BIGINT) low, CAST(count_if(c >= 0.9) AS BIGINT) high FROM (SELECT CAST({CONFIDENCE} AS DOUBLE) c FROM qa_pairs)")
def qa_stats(v):
    c = F.col("confidence")
    return transformed_pairs(v).agg(F.count(F.lit(1)).alias("total"), R(F.avg(c)).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c < 0.7).alias("low"), F.count_if(c >= 0.9).alias("high"))


@query("a66_qa_histogram", f"SELECT {KIND} kind, count(*) n FROM qa_pairs GROUP BY 1")
def qa_histogram(v):
    return transformed_pairs(v).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


TRANSFORMS = ("original", "paraphrase", "scramble")


@query("a87_success_and_degradation", "SELECT model_id, " + ", ".join(f"coalesce(round(avg(CAST(is_correct AS INTEGER)) FILTER (transform = '{t}'), 6), 0) {t}" for t in TRANSFORMS) + ", " + ", ".join(f"round(coalesce(avg(CAST(is_correct AS INTEGER)) FILTER (transform = 'original'), 0) - coalesce(avg(CAST(is_correct AS INTEGER)) FILTER (transform = '{t}'), 0), 6) {t}_loss" for t in TRANSFORMS[1:]) + " FROM evals GROUP BY model_id")
def success_and_degradation(v):
    rates = v.evals.groupBy("model_id").pivot("transform", list(TRANSFORMS)).agg(F.avg(F.col("is_correct").cast("double"))).fillna(0.0)
    return rates.select("model_id", *[R(F.col(t)).alias(t) for t in TRANSFORMS], *[R(F.col("original") - F.col(t)).alias(f"{t}_loss") for t in TRANSFORMS[1:]])


HIT = "4 * len(list_intersect(p, e)) >= len(e)"


@query("a90_flattened_metrics", rf"SELECT count(*) questions, CAST(sum(CAST({HIT} AS INTEGER)) AS BIGINT) correct, round(avg(CAST({HIT} AS INTEGER)), 6) score, round(avg(length(predicted)), 6) mean_length, max(length(predicted)) longest FROM (SELECT predicted, list_distinct(list_filter(regexp_split_to_array(lower(predicted), '\s+'), lambda w: w <> '')) p, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda w: w <> '')) e FROM qa_pairs)")
def flattened_metrics(v):
    """Results nested by conversation, as a benchmark of documents returns them, flattened and summed up."""
    own = lambda c: F.array_distinct(S.tokens(F.col(c)))
    hit = 4 * F.size(F.array_intersect(own("predicted"), own("question"))) >= F.size(own("question"))
    nested = v.qa_pairs.groupBy("conv_id").agg(F.collect_list(F.struct(hit.alias("hit"), F.length("predicted").cast("bigint").alias("length"))).alias("qa_results"))
    flat = nested.select(F.inline("qa_results"))
    return flat.agg(F.count(F.lit(1)).alias("questions"), F.sum(F.col("hit").cast("bigint")).alias("correct"), R(F.avg(F.col("hit").cast("double"))).alias("score"), R(F.avg("length")).alias("mean_length"), F.max("length").alias("longest"))


def invalidated(metrics, changed, keys: list[str]):
    """Metrics without those of keys whose responses changed, which are to be computed anew."""
    return metrics.join(changed.select(*keys).distinct(), keys, "left_anti")


@query("v3_invalidate", "SELECT experiment_id, model_id, intensity, accuracy FROM metrics WHERE NOT EXISTS (SELECT 1 FROM levels l WHERE l.response_time_ms > 4900 AND l.experiment_id = metrics.experiment_id AND l.model_id = metrics.model_id AND l.domain = 'fr')")
def invalidate(v):
    changed = v.levels.filter("response_time_ms > 4900 and domain = 'fr'")
    return invalidated(v.metrics, changed, ["experiment_id", "model_id"]).select("experiment_id", "model_id", "intensity", "accuracy")


@query("v5_sample_experiment", "SELECT experiment_id, experiment_name, status, config_hash FROM experiments UNION ALL SELECT 'x_' || md5('sample'), 'sample', 'planned', md5('sample:42')")
def sample_experiment(v):
    one = v.spark.range(1).select(F.concat(F.lit("x_"), F.md5(F.lit("sample"))).alias("experiment_id"), F.lit("sample").alias("experiment_name"), F.lit("planned").alias("status"), F.md5(F.lit("sample:42")).alias("config_hash"))
    return v.experiments.unionByName(one)


@query("v12_dependency_summary", "SELECT experiment_name, family, name, ldc, baseline_accuracy, threshold_intensity FROM thresholds JOIN experiments USING (experiment_id) JOIN models USING (model_id) WHERE ldc > 0")
def dependency_summary(v):
    t = v.thresholds.filter("ldc > 0").join(v.experiments, "experiment_id").join(v.models, "model_id")
    return t.select("experiment_name", "family", "name", "ldc", "baseline_accuracy", "threshold_intensity")


@query("v12_performance_curves", "SELECT experiment_name, family, name, method, intensity, accuracy, ci_low, ci_high, total_questions FROM metrics JOIN experiments USING (experiment_id) JOIN models USING (model_id)")
def performance_curves(v):
    m = v.metrics.join(v.experiments, "experiment_id").join(v.models, "model_id")
    return m.select("experiment_name", "family", "name", "method", "intensity", "accuracy", "ci_low", "ci_high", "total_questions")


@query("v12_model_comparison", """WITH r AS (SELECT experiment_id, model_id, count(*) total_responses, avg(CAST(is_correct AS INTEGER)) a, avg(response_time_ms) t, sum(coalesce(cost, 0)) c FROM responses WHERE is_correct IS NOT NULL GROUP BY ALL)
SELECT experiment_name, family, name, n_params, total_responses, round(a, 6) overall_accuracy, round(t, 6) avg_response_time, round(c, 6) total_cost, d.ldc AS max_dependency FROM r JOIN experiments USING (experiment_id) JOIN models USING (model_id) LEFT JOIN (SELECT experiment_id, model_id, max(ldc) ldc FROM thresholds GROUP BY ALL) d USING (experiment_id, model_id)""")
def model_comparison(v):
    r = v.responses.filter("is_correct is not null").groupBy("experiment_id", "model_id").agg(
        F.count(F.lit(1)).alias("total_responses"), R(F.avg(F.col("is_correct").cast("double"))).alias("overall_accuracy"), R(F.avg("response_time_ms")).alias("avg_response_time"), R(F.sum(F.coalesce("cost", F.lit(0.0)))).alias("total_cost")
    )
    worst = v.thresholds.groupBy("experiment_id", "model_id").agg(F.max("ldc").alias("max_dependency"))
    r = r.join(v.experiments, "experiment_id").join(v.models, "model_id").join(worst, ["experiment_id", "model_id"], "left")
    return r.select("experiment_name", "family", "name", "n_params", "total_responses", "overall_accuracy", "avg_response_time", "total_cost", "max_dependency")


@query("v12_reproducibility", "SELECT e.experiment_id, experiment_name, config_hash, status, count(DISTINCT model_id) models_tested, count(response_id) total_responses FROM experiments e LEFT JOIN responses r ON e.experiment_id = r.experiment_id GROUP BY ALL")
def reproducibility(v):
    counts = v.responses.groupBy("experiment_id", "model_id").agg(F.count(F.lit(1)).alias("n")).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("models_tested"), F.sum("n").alias("total_responses"))
    e = v.experiments.join(counts, "experiment_id", "left").fillna(0, ["models_tested", "total_responses"])
    return e.select("experiment_id", "experiment_name", "config_hash", "status", "models_tested", "total_responses")


@query("v12_health", """SELECT 'experiments' table_name, count(*) row_count, CAST(count_if(status = 'completed') AS BIGINT) done FROM experiments UNION ALL SELECT 'responses', count(*), CAST(count_if(is_correct IS NOT NULL) AS BIGINT) FROM responses
UNION ALL SELECT 'performance_metrics', count(*), count(DISTINCT experiment_id) FROM metrics UNION ALL SELECT 'threshold_analyses', count(*), CAST(count_if(threshold_intensity IS NOT NULL) AS BIGINT) FROM thresholds""")
def health(v):
    rows = lambda name, df, done: df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), done.alias("done"))
    return (
        rows("experiments", v.experiments, F.count_if(F.col("status") == "completed"))
        .unionAll(rows("responses", v.responses, F.count_if(F.col("is_correct").isNotNull())))
        .unionAll(rows("performance_metrics", v.metrics, F.countDistinct("experiment_id")))
        .unionAll(rows("threshold_analyses", v.thresholds, F.count_if(F.col("threshold_intensity").isNotNull())))
    )


@query("x3_evaluation_run", """WITH a AS (SELECT dataset, substr('ABCD', CAST(CAST('0x' || substr(md5('Q: ' || answer), 1, 2) AS INTEGER) % 4 AS INTEGER) + 1, 1) said, substr('ABCD', CAST(length(answer) % 4 AS INTEGER) + 1, 1) expected FROM items)
SELECT dataset, count(*) questions, CAST(count_if(said = expected) AS BIGINT) correct, round(avg(CAST(said = expected AS INTEGER)), 6) accuracy FROM a GROUP BY dataset""")
def evaluation_run(v):
    """Ask, score and sum up in one plan; the stand-in answers, and letters by the length of the answer are taken as right."""
    prompts = v.items.select("dataset", F.concat(F.lit("Q: "), "answer").alias("prompt"), F.substr(F.lit("ABCD"), (F.length("answer") % 4) + 1, F.lit(1)).alias("expected"))
    scored = answered(prompts).withColumn("hit", evaluators.evaluated("exact", F.col("response"), F.col("expected")))
    return scored.groupBy("dataset").agg(F.count(F.lit(1)).alias("questions"), F.count_if("hit").alias("correct"), R(F.avg(F.col("hit").cast("double"))).alias("accuracy"))


@query("x5_budget_gate", """WITH m AS (SELECT model_id, avg(cost_usd) each, count(*) done FROM evals GROUP BY model_id), p AS (SELECT model_id, each, each * done * 10 AS projected, sum(each * done * 10) OVER () AS total FROM m)
SELECT model_id, round(projected, 6) projected, total <= 1000 AS within_budget, each > 0.01 AND projected > 300 AS expensive FROM p""")
def budget_gate(v):
    """Costs projected from evaluations made so far to ten times as many, against a budget of 1000, a model being expensive from a cent each and three tenths of it."""
    m = v.evals.groupBy("model_id").agg(F.avg("cost_usd").alias("each"), (F.sum("cost_usd") * 10).alias("projected"))
    total = m.agg(F.sum("projected").alias("total"))
    p = m.join(F.broadcast(total))  # one row
    return p.select("model_id", R(F.col("projected")).alias("projected"), (F.col("total") <= 1000).alias("within_budget"), ((F.col("each") > 0.01) & (F.col("projected") > 300)).alias("expensive"))


def per_field(df, change):
    """Every text column changed by a column function; other columns stay."""
    return df.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])
