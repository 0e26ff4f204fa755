"""Sources, sinks and the remaining store operations (inventory IO), and running figures over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import windows as W
from larkspur.registry import query
from larkspur.sources import export, store
from larkspur.streaming import monitor

R = lambda c: F.round(c, 6)


@query("io14_dataset_info", "SELECT 'event_id' AS \"column\", 'bigint' AS type, count(*) AS \"rows\" FROM events UNION ALL SELECT 'value', 'double', count(*) FROM events")
def dataset_info(v):
    from larkspur.sources.load import info

    return info(v.raw("events").select("event_id", "value")).drop("sample")


@query("io19_experiment_data", "SELECT response_id, experiment_id, model_id, question_id, intensity, domain, is_correct FROM levels WHERE experiment_id = 'x_run_a' AND domain = 'en'")
def experiment_data(v):
    return v.levels.filter("experiment_id = 'x_run_a' and domain = 'en'").select("response_id", "experiment_id", "model_id", "question_id", "intensity", "domain", "is_correct")


@query("io21_upsert", "SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM items WHERE domain = 'de') THEN 'new' ELSE domain END domain FROM items")
def upserted(v):
    old = v.items.select("item_id", "domain")
    return W.upsert(old, old.filter("domain = 'de'").withColumn("domain", F.lit("new")), ["item_id"])


@query("io22_insert_if_absent", "SELECT model_id, family FROM models UNION ALL SELECT 'x:1', 'x'")
def insert_if_absent(v):
    new = v.spark.sql("SELECT * FROM VALUES ('m0'), ('x:1'), ('x:1') AS t(model_id)").withColumn("family", F.split_part("model_id", F.lit(":"), F.lit(1)))
    return store.inserted_if_absent(v.models.select("model_id", "family"), new, ["model_id"])


@query("io24_row_counts", "SELECT 'evals' AS name, count(*) n FROM evals UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'models', count(*) FROM models")
def row_counts(v):
    out = None
    for name in ("evals", "items", "models"):
        one = getattr(v, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("io26_csv_lines", """SELECT item_id, '"' || item_id || '","' || replace(dataset, '"', '""') || '","' || replace(question, '"', '""') || '"' line FROM items""")
def csv_lines(v):
    return v.items.select("item_id", export.csv_line("item_id", "dataset", "question").alias("line"))


@query("io27_key_export", "SELECT item_id, to_json({'dataset': dataset, 'domain': domain, 'item_id': item_id}) line FROM items")
def key_export(v):
    """Keys as JSON lines, one an item, so that no domain becomes one cell."""
    return v.items.select("item_id", F.to_json(F.struct("dataset", "domain", "item_id"), {"ignoreNullFields": "false"}).alias("line"))


@query("io30_remaining_models", "SELECT model_id FROM models WHERE model_id NOT IN (SELECT model_id FROM evals WHERE run_id = 'run_b' AND k > 98)")
def remaining_models(v):
    return v.models.select("model_id").join(v.evals.filter("run_id = 'run_b' and k > 98"), "model_id", "left_anti")


@query("io32_raw_sql", "SELECT run_id, count(*) n FROM evals WHERE k >= 50 GROUP BY run_id")
def raw_sql(v):
    return v.spark.sql("SELECT run_id, count(*) AS n FROM {evals} WHERE k >= :least GROUP BY run_id", args={"least": 50}, evals=v.evals)


@query("io34_filtered_results", "SELECT model_family, count(*) n, CAST(max(latency_ms) AS DOUBLE) slowest FROM evals WHERE model_family <> 'beta' GROUP BY model_family")
def filtered_results(v):
    return v.evals.filter("model_family != 'beta'").groupBy("model_family").agg(F.count(F.lit(1)).alias("n"), F.max("latency_ms").cast("double").alias("slowest"))


@query("x_running_figures", "SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS start, model_id, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy FROM evals GROUP BY ALL")
def running_figures(v):
    return monitor.running_figures(v.evals).select(F.col("start").cast("timestamp_ntz").alias("start"), "model_id", "n", R("accuracy").alias("accuracy"))


@query("x_sessions", """WITH g AS (SELECT model_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END f FROM evals WINDOW w AS (PARTITION BY model_id ORDER BY timestamp)),
s AS (SELECT model_id, timestamp, sum(f) OVER (PARTITION BY model_id ORDER BY timestamp) s FROM g) SELECT model_id, min(timestamp) AS start, max(timestamp) + INTERVAL 30 MINUTE AS "end", count(*) n FROM s GROUP BY model_id, s""")
def sessions(v):
    return W.sessions(v.evals, "model_id", "timestamp", 30).select("model_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("a60_recent_rates", "SELECT model_id, round(avg(CAST(is_correct AS INTEGER)), 6) success, round(avg(latency_ms), 6) latency FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY timestamp DESC, eval_id) n FROM evals) WHERE n <= 1000 GROUP BY model_id")
def recent_rates(v):
    w = Window.partitionBy("model_id").orderBy(F.desc("timestamp"), "eval_id")
    return v.evals.withColumn("n", F.row_number().over(w)).filter("n <= 1000").groupBy("model_id").agg(R(F.avg(F.col("is_correct").cast("int"))).alias("success"), R(F.avg("latency_ms")).alias("latency"))
