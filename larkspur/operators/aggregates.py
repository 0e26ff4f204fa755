"""Aggregates of evaluation results. Each is one grouping with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(flag: str = "is_correct") -> Column:
    """Share of true rows; null rows do not count."""
    return F.avg(F.col(flag).cast("double"))


def rate_where(condition: str, flag: str = "is_correct") -> Column:
    return F.avg(F.when(F.expr(condition), F.col(flag).cast("double")))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of a proportion."""
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def canonical_metrics(evals: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of each transform and level, beside the accuracy on originals: retention acc / acc0 and dependency 1 - retention; 0 where acc0 is 0 or missing."""
    cells = evals.groupBy(*keys, "transform", "scramble_level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("double")).alias("hits"), F.count("is_correct").alias("scored"))
    acc = F.try_divide("hits", "scored")
    originals = F.max(F.when(F.col("transform") == "original", acc)).over(Window.partitionBy(*keys))
    rrs = F.coalesce(F.try_divide(F.col("acc"), F.col("acc0")), F.lit(0.0))
    return cells.select(*keys, "transform", "scramble_level", "n", acc.alias("acc"), originals.alias("acc0")).withColumn("rrs", rrs).withColumn("ldc", F.when(F.col("acc0") > 0, 1 - F.col("rrs")).otherwise(0.0))


def performance_metrics(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, accuracy, response times, cost and Wilson interval per group, rounded to six places."""
    hit = F.col("is_correct").cast("double")
    p, n = F.avg(hit), F.count(F.lit(1))
    low, high = wilson(p, n)
    r = lambda c: F.round(c, 6)
    return levels.groupBy(*keys).agg(
        n.alias("total_questions"), F.sum(hit).cast("bigint").alias("correct_answers"), r(p).alias("accuracy"), r(F.stddev_samp(hit)).alias("accuracy_std"),
        r(F.avg("response_time_ms")).alias("avg_response_time"), r(F.median("response_time_ms")).alias("median_response_time"), r(F.stddev_samp("response_time_ms")).alias("std_response_time"),
        r(F.sum("cost")).alias("total_cost"), r(low).alias("ci_low"), r(high).alias("ci_high"),
    )


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Per label: true positives, predicted, actual, precision, recall and F1; 0 where a denominator is 0."""
    cells = df.groupBy(F.col(predicted).alias("p"), F.col(actual).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("actual")).unionAll(
        cells.select("p", F.lit(0).cast("bigint"), F.col("n"), F.lit(0).cast("bigint"))
    )
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "actual")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.withColumns({"precision": zero(F.try_divide("tp", "predicted")), "recall": zero(F.try_divide("tp", "actual"))})
    return per.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max with linear interpolation, and the least of the most frequent values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    mode = counts.orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("mode"))
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return stats.select("count", "mean", "std", "min", *[F.col("q")[k].alias(f"p{p}") for k, p in enumerate((25, 50, 75))], "max").crossJoin(mode)


def codebook(df: DataFrame) -> DataFrame:
    """One row for each column: type, nulls and distinct values, from one pass."""
    aggregates = [f(c).alias(f"{n}{k}") for k, c in enumerate(df.columns) for n, f in (("n", lambda c: F.count_if(F.col(c).isNull())), ("u", F.count_distinct))]
    one = df.agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{k}").alias("nulls"), F.col(f"u{k}").alias("uniques")) for k, (c, t) in enumerate(df.dtypes)]
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, empty bins left out."""
    edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    bin_ = F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo")))).cast("bigint")
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
