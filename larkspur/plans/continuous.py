"""Resampling and smoothing of continuous columns, and stored aggregates that follow changes (inventory ST, V, IO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import bootstrap as B
from larkspur.operators import smooth
from larkspur.plans.statistics import ROUNDS
from larkspur.registry import query
from larkspur.sources.scratch import scratch
from larkspur.sources.upkeep import Upkeep

LINE = ["l_orderkey", "l_linenumber"]


@query("st12_price_by_strata")
def price_by_strata(v):
    """Mean price by flag, lines resampled within their status."""
    return B.mean_interval(v.raw("lineitem"), "l_returnflag", "l_extendedprice", LINE, ROUNDS, ["l_linestatus"])


@query("st14_price_bca")
def price_bca(v):
    return B.bca_interval(v.raw("lineitem"), "l_returnflag", "l_extendedprice", LINE, ROUNDS)


@query("st16_price_parameters")
def price_parameters(v):
    """Whether an order is finished, on its price, by priority."""
    orders = v.raw("orders").withColumn("finished", (F.col("o_orderstatus") == "F").cast("double"))
    return B.parameter_intervals(orders, "o_orderpriority", "o_totalprice", "finished", ["o_orderkey"], ROUNDS)


@query("st21_penalised_spline")
def penalised_spline(v):
    """Smooth logistic curve of correctness over the value k, by family; the penalty on its curvature has the least unbiased risk."""
    tried = v.evals.select("model_family", "k", F.col("is_correct").cast("double").alias("y"))
    return smooth.table(tried, "model_family", smooth.penalised_spline(tried, "model_family", "k", "y"))


@query("st21_smooth_price")
def smooth_price(v):
    """Smooth curve of the price of a line over its quantity, by flag; the penalty has the least cross-validation score."""
    lines = v.raw("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return smooth.table(lines, "l_returnflag", smooth.penalised_spline(lines, "l_returnflag", "l_quantity", "l_extendedprice", binomial=False), binomial=False)


@query(
    "v3_upkeep",
    """SELECT model_id, transform, count(*) n, CAST(coalesce(sum(hit), 0) AS BIGINT) hits, CAST(coalesce(sum(ms), 0) AS BIGINT) latency, round(avg(ms), 6) mean_latency
FROM (SELECT model_id, transform, k, CASE WHEN k % 3 = 0 THEN 1 - CAST(is_correct AS INTEGER) ELSE CAST(is_correct AS INTEGER) END hit, CASE WHEN k % 3 = 0 THEN latency_ms + 5 ELSE latency_ms END ms FROM evals)
WHERE k IS NULL OR k % 7 <> 1 GROUP BY model_id, transform""",
)
def upkeep(v):
    """Metrics stored from two runs, then answers rescored and others withdrawn: only differences are merged, and the store equals a recomputation."""
    rows = v.evals.select("run_id", "model_id", "transform", "k", F.col("is_correct").cast("int").alias("hit"), F.col("latency_ms").alias("ms"))
    store = Upkeep(v.spark, scratch(v.spark, "upkeep"), ["model_id", "transform"], ["hit", "ms"], 16)
    for run in ("run_a", "run_b"):
        store.change(rows.filter(F.col("run_id") == run))
    rescored, withdrawn = F.coalesce(F.col("k") % 3 == 0, F.lit(False)), F.coalesce(F.col("k") % 7 == 1, F.lit(False))
    old = rows.filter(rescored | withdrawn)
    new = rows.filter(rescored & ~withdrawn).withColumns({"hit": 1 - F.col("hit"), "ms": F.col("ms") + 5})
    store.change(new, old)
    total = lambda c: F.col(f"total_{c}").cast("bigint")
    return store.read(rows).select("model_id", "transform", "n", total("hit").alias("hits"), total("ms").alias("latency"), F.round("mean_ms", 6).alias("mean_latency"))
