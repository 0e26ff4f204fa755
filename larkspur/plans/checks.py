"""Checks of runs before and after they are made, and printed reports (inventory V8, X8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import render
from larkspur.operators import aggregates as A
from larkspur.operators import validate
from larkspur.registry import query
from larkspur.sources import results
from larkspur.sources.scratch import scratch

#: Limits of a smoke run: dollars, items of a dataset, seconds.
MOST_COST, MOST_ITEMS, MOST_SECONDS = 10.0, 50, 600.0
PER_MODEL = "(SELECT run_id, model_id, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 3) a FROM evals GROUP BY run_id, model_id)"


@query("v8_required_fields", """SELECT field, CAST(count_if(NOT coalesce(json_exists(props, '$.' || field), false)) AS BIGINT) missing
 FROM events, (VALUES ('run'), ('datasets'), ('transforms'), ('models'), ('k')) t(field) GROUP BY field""")
def required_fields(v):
    return validate.missing_fields(v.raw("events"), "props", ["run", "datasets", "transforms", "models", "k"])


@query("v8_limits", f"""WITH r AS (SELECT run_id, sum(cost_usd) c, sum(latency_ms) / 1000.0 s FROM evals GROUP BY run_id),
d AS (SELECT run_id, dataset, count(DISTINCT item_id) n FROM evals JOIN items USING (item_id) GROUP BY run_id, dataset)
SELECT 'warning' severity, 'cost' category, run_id subject, round(c, 6) "value" FROM r WHERE c > {MOST_COST}
UNION ALL SELECT 'warning', 'sample_size', run_id || '/' || coalesce(dataset, ''), CAST(n AS DOUBLE) FROM d WHERE n > {MOST_ITEMS}
UNION ALL SELECT 'critical', 'performance', run_id, round(s, 6) FROM r WHERE s > {MOST_SECONDS}""")
def limits(v):
    runs = v.evals.groupBy("run_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost"), F.round(F.sum("latency_ms") / 1000.0, 6).alias("seconds"))
    asked = v.evals.select("run_id", "item_id").distinct().join(v.items.select("item_id", "dataset"), "item_id").groupBy("run_id", "dataset").agg(F.count(F.lit(1)).alias("n"))
    return (
        validate.over_limit(runs, F.col("run_id"), "cost", MOST_COST, "warning", "cost")
        .unionAll(validate.over_limit(asked, F.concat("run_id", F.lit("/"), F.coalesce("dataset", F.lit(""))), "n", MOST_ITEMS, "warning", "sample_size"))
        .unionAll(validate.over_limit(runs, F.col("run_id"), "seconds", MOST_SECONDS, "critical", "performance"))
    )


@query("v8_run_data", "SELECT experiment_id, count(response_id) n, CASE WHEN count(response_id) = 0 THEN 'critical' END severity FROM (SELECT experiment_id FROM experiments UNION ALL SELECT 'x_run_c') e LEFT JOIN responses USING (experiment_id) GROUP BY experiment_id")
def run_data(v):
    """Runs without rows, among those known and one that was announced only."""
    known = v.experiments.select("experiment_id").unionAll(v.spark.sql("SELECT 'x_run_c'"))
    counts = known.join(v.responses.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")), "experiment_id", "left").fillna(0, ["n"])
    return counts.select("experiment_id", "n", F.when(F.col("n") == 0, "critical").alias("severity"))


def _per_model(v):
    return v.evals.groupBy("run_id", "model_id").agg(F.count(F.lit(1)).alias("n"), A.rate().alias("a"))


@query("x8_latex_rows", rf"SELECT replace(run_id, '_', '\_') || ' & ' || model_id || ' & ' || n || ' & ' || printf('%.3f', a) || ' \\' AS line FROM {PER_MODEL}")
def latex_rows(v):
    return _per_model(v).select(render.latex_row(render.latex_text(F.col("run_id")), F.col("model_id"), F.col("n").cast("string"), render.fixed(F.col("a"))).alias("line"))


@query("x8_markdown_rows", f"SELECT '| ' || run_id || ' | ' || model_id || ' | ' || n || ' | ' || printf('%.3f', a) || ' |' AS line FROM {PER_MODEL}")
def markdown_rows(v):
    return _per_model(v).select(render.markdown_row(F.col("run_id"), F.col("model_id"), F.col("n").cast("string"), render.fixed(F.col("a"))).alias("line"))


@query("x8_locked_plans", """SELECT experiment_id, sha256('{"config_hash":"' || config_hash || '","experiment_id":"' || experiment_id || '","experiment_name":"' || experiment_name || '"}') lock FROM experiments""")
def locked_plans(v):
    return v.experiments.select("experiment_id", results.content_lock("experiment_id", "experiment_name", "config_hash").alias("lock"))


@query("x8_manifest", "SELECT CAST(sum(strlen(r_name) + 1) AS BIGINT) size_bytes, sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) sha256 FROM region")
def manifest(v):
    path = scratch(v.spark, "manifest")
    v.raw("region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path)
    return results.manifest(v.spark, path).select("size_bytes", "sha256")
