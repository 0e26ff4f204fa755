"""Loading, saving and exporting, as round trips through files (inventory IO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import transform as X
from larkspur.registry import query
from larkspur.sources import load, results
from larkspur.sources.scratch import scratch

R = lambda c: F.round(c, 6)
ALPHABET = X.LOWER + X.LOWER.upper()


@query("io1_load_by_name", "SELECT item_id, md5(text) digest FROM benchmark")
def load_by_name(v):
    """A bare name, found in the folder given with the suffix of its format."""
    return load.read_dataset(v.spark, "benchmark", folders=(v.sf_dir,)).select("item_id", F.md5("text").alias("digest"))


@query("io2_resolve_path", "SELECT n_nationkey, n_name FROM nation")
def resolve_path(v):
    return load.read_dataset(v.spark, load.resolve(v.spark, f"{v.sf_dir}/nation.parquet")).select("n_nationkey", "n_name")


@query("io3_format_by_suffix", "SELECT doc_id, n_chars FROM documents")
def format_by_suffix(v):
    path = scratch(v.spark, "suffix") + ".jsonl"
    v.raw("documents").select("doc_id", "n_chars").write.json(path)
    return load.read_dataset(v.spark, path).select("doc_id", F.col("n_chars"))


@query("io4_json_list", "SELECT r_regionkey, r_name FROM region")
def json_list(v):
    """One object that holds its rows under a known name."""
    path = scratch(v.spark, "list") + ".json"
    whole = v.raw("region").agg(F.to_json(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("examples"))).alias("value"))
    whole.coalesce(1).write.text(path)
    df = load.read_dataset(v.spark, path)
    return df.select(F.col("r_regionkey").cast(v.raw("region").schema["r_regionkey"].dataType).alias("r_regionkey"), "r_name")


@query("io5_json_lines", "SELECT doc_id, md5(text) digest FROM documents")
def json_lines(v):
    """Blank and malformed lines between the rows are skipped."""
    path = scratch(v.spark, "lines") + ".jsonl"
    good = v.raw("documents").select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    bad = v.raw("region").select(F.explode(F.array(F.lit(""), F.lit("{broken"), F.lit("[1, 2"))).alias("value"))
    good.unionAll(bad).write.text(path)
    return load.read_dataset(v.spark, path).filter("doc_id is not null").select("doc_id", F.md5("text").alias("digest"))


@query("io6_numbered_lines", "SELECT n_name AS value, row_number() OVER (ORDER BY n_nationkey) - 1 AS line FROM nation")
def numbered_lines(v):
    path = scratch(v.spark, "numbered")
    v.raw("nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.col("n_name").alias("value")).write.text(path)
    return load.numbered_lines(v.spark, path).select("value", "line")


@query("io7_csv_with_json_cells", "SELECT CAST(s_suppkey AS VARCHAR) s_suppkey, s_name, CAST(s_nationkey AS BIGINT) nation FROM supplier")
def csv_with_json_cells(v):
    path = scratch(v.spark, "cells") + ".csv"
    s = v.raw("supplier").select("s_suppkey", "s_name", F.struct("s_nationkey").alias("about"))
    load.convert(s, path, "csv")
    df = load.json_cells(load.read_dataset(v.spark, path), ["about"])
    return df.select("s_suppkey", "s_name", F.try_variant_get("about_json", "$.s_nationkey", "bigint").alias("nation"))


@query("io8_parquet", "SELECT o_orderkey, o_custkey FROM orders")
def parquet(v):
    path = scratch(v.spark, "orders") + ".parquet"
    load.convert(v.raw("orders").select("o_orderkey", "o_custkey"), path, "parquet")
    return load.read_dataset(v.spark, path)


@query("io11_custom_loader", "SELECT c_custkey, upper(c_name) c_name FROM customer")
def custom_loader(v):
    load.register_loader("upper-names", lambda spark, path: spark.read.parquet(path).select("c_custkey", F.upper("c_name").alias("c_name")))
    return load.read_dataset(v.spark, "customer", "upper-names", (v.sf_dir,))


@query("io13_result_cache", "SELECT model_id, count(*) n FROM evals GROUP BY model_id")
def result_cache(v):
    """Made once; the second call reads what the first has stored."""
    cache = results.ResultCache(v.spark, scratch(v.spark, "cache"), most=2)
    made = lambda: v.evals.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    cache.get("per_model", made, sf=v.sf_dir)
    return cache.get("per_model", lambda: made().limit(0), sf=v.sf_dir)


@query("io15_list_datasets", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', 'parquet')" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()) + ") t(name, format)")
def list_datasets(v):
    return results.list_datasets(v.spark, v.sf_dir)


@query("io16_convert", "SELECT doc_id, md5(text) digest, lang FROM documents WHERE text IS NOT NULL")
def convert(v):
    """Parquet to ORC to JSON lines."""
    a, b = scratch(v.spark, "a") + ".orc", scratch(v.spark, "b") + ".jsonl"
    load.convert(v.raw("documents").select("doc_id", "text", "lang"), a, "orc")
    load.convert(load.read_dataset(v.spark, a), b, "jsonl")
    return load.read_dataset(v.spark, b).filter("text is not null").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("io17_save_results", "SELECT '{\"seed\": 42}' AS config, '{\"by\": \"test\"}' AS metadata, count(*) results FROM evals")
def save_results(v):
    path = scratch(v.spark, "saved")
    results.save_results(v.evals.select("eval_id", "model_id", "is_correct"), path, "both", {"seed": 42}, {"by": "test"})
    return v.spark.read.json(f"{path}/about.json")


@query("io18_load_results", "SELECT eval_id, model_id, is_correct FROM evals")
def load_results(v):
    path = scratch(v.spark, "loaded")
    results.save_results(v.evals.select("eval_id", "model_id", "is_correct", F.lit("a long body").alias("problem")), path, "parquet")
    return results.load_results(v.spark, path)


@query("io20_append_rows", "SELECT run_id, count(*) n FROM evals GROUP BY run_id")
def append_rows(v):
    path = scratch(v.spark, "appended")
    for run in ("run_a", "run_b"):
        results.append_rows(v.evals.filter(F.col("run_id") == run).select("run_id", "eval_id"), path)
    return v.spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("io25_codebook", "SELECT 'eval_id' AS \"column\", 'string' AS type, count(eval_id) present, 'key' AS meaning FROM evals UNION ALL SELECT 'scramble_level', 'double', count(scramble_level), '' FROM evals UNION ALL SELECT 'is_correct', 'boolean', count(is_correct), 'outcome' FROM evals")
def codebook(v):
    path = scratch(v.spark, "codebook")
    frame = v.evals.select("eval_id", "scramble_level", "is_correct")
    results.export_csv(frame, f"{path}/data.csv")
    results.export_csv(results.codebook(frame, {"eval_id": "key", "is_correct": "outcome"}), f"{path}/codebook.csv")
    book = v.spark.read.option("header", "true").csv(f"{path}/codebook.csv")
    return book.select("column", "type", F.col("present").cast("bigint").alias("present"), F.coalesce("meaning", F.lit("")).alias("meaning"))


@query("io28_language", f"SELECT DISTINCT w word, translate(w, '{X.LOWER}', '{X.rotated(13)}') form FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) w FROM benchmark)")
def language(v):
    """A substitution language over all words of the benchmark, saved and loaded."""
    path = scratch(v.spark, "language")
    words = v.raw("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    words.withColumn("form", X.caesar(F.col("word"), 13)).write.json(path)
    return v.spark.read.schema("word string, form string").json(path)


@query("io29_transformation_sets", f"SELECT item_id, 'original' kind, md5(text) result FROM benchmark UNION ALL SELECT item_id, 'caesar', md5(translate(text, '{ALPHABET}', '{X.rotated(3) + X.rotated(3).upper()}')) FROM benchmark")
def transformation_sets(v):
    """One row an item with all its transformations nested, saved and loaded."""
    path = scratch(v.spark, "sets")
    made = F.array(F.struct(F.lit("original").alias("kind"), F.col("text").alias("result")), F.struct(F.lit("caesar").alias("kind"), X.caesar(F.col("text"), 3).alias("result")))
    v.raw("benchmark").select("item_id", made.alias("transformations")).write.parquet(path)
    return v.spark.read.parquet(path).select("item_id", F.inline("transformations")).select("item_id", "kind", F.md5("result").alias("result"))


@query("io31_vocabulary", "SELECT w word, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) w FROM benchmark) GROUP BY w")
def vocabulary(v):
    path = scratch(v.spark, "vocabulary")
    words = v.raw("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).write.json(path)
    return v.spark.read.schema("word string, n bigint").json(path)


@query("io33_exports", "SELECT model_id, count(*) n, round(avg(CAST(is_correct AS INTEGER)), 6) accuracy, round(sum(cost_usd), 6) AS cost FROM evals GROUP BY model_id")
def exports(v):
    path = scratch(v.spark, "exports")
    table = v.evals.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.col("is_correct").cast("double"))).alias("accuracy"), R(F.sum("cost_usd")).alias("cost"))
    results.export_csv(table, path)
    return v.spark.read.option("header", "true").schema("model_id string, n bigint, accuracy double, cost double").csv(path)
