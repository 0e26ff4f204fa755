"""The study's tables over the driver's: evaluations from events, items from documents.

``views(spark, sf_dir)`` gives DataFrames; ``SQL`` states the same tables as
common table expressions for the oracle. Nothing is read until a view is used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Billions of parameters by model number, and accuracy bases by kind of event.
N_PARAMS = [0.27, 1.0, 2.0, 4.0, 9.0, 20.0, 27.0, 70.0]
BASES = {"view": 20, "click": 24, "purchase": 30, "signup": 45, "error": 60}
LEVELS = {"purchase": 0.1, "signup": 0.3, "error": 0.5}
LOAD_WORDS = (150, 400)


def _by(column, values: dict):
    out = None
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def evals(self) -> DataFrame:
        e = self.raw("events")
        m, kind, level = F.col("user_id") % 8, F.col("event_type"), _by(F.col("event_type"), LEVELS)
        # Events go round all documents, whose ids count from 0; a plan that does not use item_id does not count them.
        documents = self.raw("documents").agg(F.count(F.lit(1))).scalar()
        return e.select(
            F.concat(F.lit("e"), "event_id").alias("eval_id"),
            F.when(F.col("event_id") % 10 < 8, "run_a").otherwise("run_b").alias("run_id"),
            F.concat(F.lit("i"), F.col("event_id") % F.nullif(documents, F.lit(0))).alias("item_id"),
            F.concat(F.lit("m"), m).alias("model_id"),
            F.when(m <= 2, "alpha").when(m <= 5, "beta").otherwise("gamma").alias("model_family"),
            (_by(m, dict(enumerate(N_PARAMS))) * F.lit(1e9)).alias("n_params"),
            F.when(kind == "view", "original").when(kind == "click", "paraphrase").otherwise("scramble").alias("transform"),
            level.alias("scramble_level"),
            (F.col("value") > _by(kind, BASES) - 2 * m).alias("is_correct"),
            F.floor(F.col("value") * 10).alias("latency_ms"),
            (F.col("value") / 10000).alias("cost_usd"),
            F.col("ts").alias("timestamp"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (F.coalesce(level, F.lit(0.0)) * F.get_json_object("props", "$.k").cast("bigint") / 100).alias("tok_kl"),
            (1 + F.coalesce(level, F.lit(0.0))).alias("tok_frag"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("documents").select(F.concat(F.lit("i"), "doc_id").alias("item_id"), F.col("source").alias("dataset"), F.col("lang").alias("domain"), F.col("text").alias("question"), F.substring_index("text", " ", 1).alias("answer"))

    @cached_property
    def models(self) -> DataFrame:
        return self.evals.select("model_id", F.concat(F.lit("model-"), "model_id").alias("name"), F.col("model_family").alias("family"), "n_params").distinct()

    @cached_property
    def responses(self) -> DataFrame:
        """Atlas responses: intensity on a scale of 0 to 100, original or scrambled question."""
        e, base = self.evals, F.coalesce(F.col("scramble_level"), F.lit(0.0))
        return e.filter("transform != 'paraphrase'").select(
            F.col("eval_id").alias("response_id"),
            F.concat(F.lit("x_"), "run_id").alias("experiment_id"),
            "model_id",
            F.when(F.col("scramble_level").isNull(), F.col("item_id")).alias("original_question_id"),
            F.when(F.col("scramble_level").isNotNull(), F.concat("item_id", F.lit("_"), F.round(base * 100).cast("int"))).alias("scrambled_question_id"),
            "is_correct",
            F.col("latency_ms").alias("response_time_ms"),
            F.col("cost_usd").alias("cost"),
            "timestamp",
            F.col("k").alias("token_count"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        words = F.size(F.filter(F.split("question", r"\s+"), lambda w: w != ""))
        return self.items.select(F.col("item_id").alias("question_id"), F.col("dataset").alias("benchmark_id"), "domain", "question", words.cast("bigint").alias("n_words"))

    @cached_property
    def scrambled(self) -> DataFrame:
        level = F.explode(F.array(*[F.lit(x) for x in (10, 30, 50)])).alias("intensity")
        return self.questions.select(F.col("question_id").alias("original_question_id"), level).select(
            F.concat("original_question_id", F.lit("_"), "intensity").alias("scrambled_question_id"), "original_question_id", F.lit("character").alias("method"), F.col("intensity").cast("double").alias("intensity")
        )

    @cached_property
    def experiments(self) -> DataFrame:
        return self.spark.sql("SELECT * FROM VALUES ('x_run_a', 'first', 'completed', 'h1'), ('x_run_b', 'second', 'running', 'h2') AS t(experiment_id, experiment_name, status, config_hash)")

    @cached_property
    def levels(self) -> DataFrame:
        """Responses with the question they belong to, its domain and the intensity, 0 for originals."""
        from larkspur.operators.joins import resolve_questions

        return resolve_questions(self.responses, self.scrambled, self.questions)

    @cached_property
    def metrics(self) -> DataFrame:
        from larkspur.operators.aggregates import performance_metrics

        return performance_metrics(self.levels, ["experiment_id", "model_id", "method", "intensity"])

    @cached_property
    def thresholds(self) -> DataFrame:
        from larkspur.operators.statistics import threshold_analysis

        return threshold_analysis(self.levels, ["experiment_id", "model_id"])

    @cached_property
    def qa_pairs(self) -> DataFrame:
        c = self.raw("conversations")
        u, a = c.filter("role = 'user'"), c.filter("role = 'assistant'")
        return u.alias("u").join(a.alias("a"), (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1)).select(
            F.col("u.conv_id"), F.col("u.turn"), F.col("u.text").alias("question"), F.col("a.text").alias("predicted")
        )


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)


SQL = """WITH evals AS (
  SELECT 'e' || event_id AS eval_id, CASE WHEN event_id % 10 < 8 THEN 'run_a' ELSE 'run_b' END AS run_id,
    'i' || (event_id % (SELECT count(*) FROM documents)) AS item_id, 'm' || (user_id % 8) AS model_id,
    CASE WHEN user_id % 8 <= 2 THEN 'alpha' WHEN user_id % 8 <= 5 THEN 'beta' ELSE 'gamma' END AS model_family,
    CAST(list_extract([0.27, 1, 2, 4, 9, 20, 27, 70], CAST(user_id % 8 + 1 AS INTEGER)) AS DOUBLE) * CAST(1e9 AS DOUBLE) AS n_params,
    CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'paraphrase' ELSE 'scramble' END AS transform,
    CAST(CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'signup' THEN 0.3 WHEN 'error' THEN 0.5 END AS DOUBLE) AS scramble_level,
    value > CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 24 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 45 ELSE 60 END - 2 * (user_id % 8) AS is_correct,
    CAST(floor(value * 10) AS BIGINT) AS latency_ms, value / 10000 AS cost_usd, ts AS timestamp,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
evals2 AS (SELECT *, coalesce(scramble_level, 0) * k / 100 AS tok_kl, 1 + coalesce(scramble_level, 0) AS tok_frag FROM evals),
items AS (SELECT 'i' || doc_id AS item_id, source AS dataset, lang AS domain, text AS question, split_part(text, ' ', 1) AS answer FROM documents),
models AS (SELECT DISTINCT model_id, 'model-' || model_id AS name, model_family AS family, n_params FROM evals),
responses AS (
  SELECT eval_id AS response_id, 'x_' || run_id AS experiment_id, model_id,
    CASE WHEN scramble_level IS NULL THEN item_id END AS original_question_id,
    CASE WHEN scramble_level IS NOT NULL THEN item_id || '_' || CAST(round(scramble_level * 100) AS INTEGER) END AS scrambled_question_id,
    is_correct, latency_ms AS response_time_ms, cost_usd AS cost, timestamp, k AS token_count
  FROM evals WHERE transform <> 'paraphrase'),
questions AS (SELECT item_id AS question_id, dataset AS benchmark_id, domain, question, CAST(len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM items),
scrambled AS (SELECT question_id || '_' || l AS scrambled_question_id, question_id AS original_question_id, 'character' AS method, CAST(l AS DOUBLE) AS intensity FROM questions, (VALUES (10), (30), (50)) t(l)),
experiments AS (SELECT * FROM (VALUES ('x_run_a', 'first', 'completed', 'h1'), ('x_run_b', 'second', 'running', 'h2')) AS t(experiment_id, experiment_name, status, config_hash)),
levels AS (
  SELECT r.*, coalesce(r.original_question_id, s.original_question_id) AS question_id, 'character' AS method, coalesce(s.intensity, 0) AS intensity, q.domain, q.benchmark_id, q.n_words
  FROM responses r LEFT JOIN scrambled s ON r.scrambled_question_id = s.scrambled_question_id
  JOIN questions q ON q.question_id = coalesce(r.original_question_id, s.original_question_id)),
metrics AS (
  SELECT experiment_id, model_id, method, intensity, count(*) AS total_questions, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS correct_answers,
    round(avg(CAST(is_correct AS INTEGER)), 6) AS accuracy, round(stddev_samp(CAST(is_correct AS INTEGER)), 6) AS accuracy_std,
    round(avg(response_time_ms), 6) AS avg_response_time, round(median(response_time_ms), 6) AS median_response_time, round(stddev_samp(response_time_ms), 6) AS std_response_time,
    round(sum(cost), 6) AS total_cost,
    round((avg(CAST(is_correct AS INTEGER)) + 1.96 * 1.96 / (2 * count(*)) - 1.96 * sqrt((avg(CAST(is_correct AS INTEGER)) * (1 - avg(CAST(is_correct AS INTEGER))) + 1.96 * 1.96 / (4 * count(*))) / count(*))) / (1 + 1.96 * 1.96 / count(*)), 6) AS ci_low,
    round((avg(CAST(is_correct AS INTEGER)) + 1.96 * 1.96 / (2 * count(*)) + 1.96 * sqrt((avg(CAST(is_correct AS INTEGER)) * (1 - avg(CAST(is_correct AS INTEGER))) + 1.96 * 1.96 / (4 * count(*))) / count(*))) / (1 + 1.96 * 1.96 / count(*)), 6) AS ci_high
  FROM levels GROUP BY ALL),
level_means AS (SELECT experiment_id, model_id, intensity, avg(CAST(is_correct AS INTEGER)) AS accuracy FROM levels GROUP BY ALL),
thresholds AS (
  SELECT experiment_id, model_id, round(b.accuracy, 6) AS baseline_accuracy, min(l.intensity) FILTER (l.intensity > 0 AND l.accuracy < 0.5 * b.accuracy) AS threshold_intensity,
    round(greatest(0, least(1, 1 - avg(l.accuracy) FILTER (l.intensity > 0) / nullif(b.accuracy, 0))), 6) AS ldc
  FROM level_means l JOIN (SELECT experiment_id, model_id, accuracy FROM level_means WHERE intensity = 0) b USING (experiment_id, model_id) GROUP BY experiment_id, model_id, b.accuracy),
qa_pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS predicted FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
"""
