"""Closed-form statistics on group moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_analysis(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: baseline accuracy, the smallest intensity at which accuracy is below half of it, and dependency, 1 - mean of level means / baseline, within 0 and 1."""
    means = levels.groupBy(*keys, "intensity").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"))
    base = F.max(F.when(F.col("intensity") == 0, F.col("accuracy"))).over(Window.partitionBy(*keys))
    means = means.withColumn("base", base).filter("base is not null")
    above = F.col("intensity") > 0
    ldc = 1 - F.try_divide(F.avg(F.when(above, F.col("accuracy"))), F.first("base"))
    return means.groupBy(*keys).agg(
        F.round(F.first("base"), 6).alias("baseline_accuracy"),
        F.min(F.when(above & (F.col("accuracy") < 0.5 * F.col("base")), F.col("intensity"))).alias("threshold_intensity"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ldc)), 6).alias("ldc"),
    )


def moments(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def welch(pairs: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """Adds difference, t, pooled Cohen's d and the interval of the difference to rows that hold n, mean and var of two groups."""
    n1, n2, m1, m2, v1, v2 = (F.col(c + s) for c in ("n", "mean", "var") for s in (a, b))
    se = F.sqrt(v1 / n1 + v2 / n2)
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return pairs.withColumns({"difference": m1 - m2, "t": F.try_divide(m1 - m2, se), "d": F.try_divide(m1 - m2, pooled), "low": m1 - m2 - 1.96 * se, "high": m1 - m2 + 1.96 * se})


def average_rank(column: str, *partition: str) -> Column:
    """Rank from 1 with ties sharing the mean of their places."""
    w = Window.partitionBy(*partition).orderBy(column)
    same = Window.partitionBy(*partition, column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": average_rank(x, *keys), "_y": average_rank(y, *keys)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))


def corrected(df: DataFrame, p: str, method: str, *order: str) -> DataFrame:
    """Adjusted p-values: bonferroni, holm or bh (Benjamini-Hochberg)."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    up = Window.orderBy(p, *order)
    k = F.row_number().over(up)
    if method == "bonferroni":
        return df.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * m))
    if method == "holm":
        return df.withColumn("_s", F.col(p) * (m - k + 1)).withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(up.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
    return df.withColumn("_s", F.col(p) * m / k).withColumn("adjusted", F.least(F.lit(1.0), F.min("_s").over(up.rowsBetween(0, Window.unboundedFollowing)))).drop("_s")


def information_weights(fits: DataFrame, criterion: str, by: list[str] | None = None) -> DataFrame:
    """Differences to the least criterion, weights exp(-d/2) that sum to 1 for each value of ``by``, rank, running weight, evidence ratio of the best and its logarithm."""
    by = by or []
    everything = Window.partitionBy(*by)
    delta = F.col(criterion) - F.min(criterion).over(everything)
    out = fits.withColumn("delta", delta).withColumn("weight", F.exp(-0.5 * F.col("delta")) / F.sum(F.exp(-0.5 * F.col("delta"))).over(everything))
    order = Window.partitionBy(*by).orderBy("delta", "name")
    running = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"rank": F.row_number().over(order), "running": running, "evidence": F.try_divide(F.max("weight").over(everything), F.col("weight")), "log_evidence": F.col("delta") / 2})


def gaussian_fits(df: DataFrame, key: str, x: str, y: str, group: str, at: float, of: str) -> DataFrame:
    """Three least-squares models of y for each key, from moments alone: a constant, a line in x, and a mean for each value of group.

    Returns key, name, parameters (with that of the spread), rows, rss, log_likelihood, aic, bic, and what each predicts for
    x = ``at`` in the group ``of``; intercept, slope and slope_se of the line.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(group).alias("_g"))
    whole = known.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("var"), F.var_pop("_x").alias("var_x"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.coalesce(F.regr_r2("_y", "_x"), F.lit(0.0)).alias("r2"))
    parts = known.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("n"), F.var_pop("_y").alias("v"), F.avg("_y").alias("m"))
    parts = parts.groupBy(key).agg(F.sum(F.col("n") * F.col("v")).alias("within"), F.count(F.lit(1)).alias("groups"), F.max(F.when(F.col("_g") == of, F.col("m"))).alias("of"))
    both = whole.join(parts, key)
    model = lambda name, parameters, rss, predicted: F.struct(F.lit(name).alias("name"), parameters.cast("bigint").alias("parameters"), rss.alias("rss"), predicted.alias("predicted"))
    line = F.col("intercept") + F.col("slope") * at
    models = F.array(model("constant", F.lit(2), F.col("var") * F.col("rows"), F.col("mean")), model("linear", F.lit(3), F.col("var") * F.col("rows") * (1 - F.col("r2")), line), model("grouped", F.col("groups") + 1, F.col("within"), F.col("of")))
    fits = both.select(key, "rows", "intercept", "slope", F.sqrt(F.try_divide(F.col("var") * (1 - F.col("r2")), (F.col("rows") - 2) * F.col("var_x"))).alias("slope_se"), F.inline(models))
    n = F.col("rows")
    ll = -n / 2 * (F.log(F.lit(2 * 3.141592653589793)) + F.log(F.col("rss") / n) + 1)
    fits = fits.withColumn("log_likelihood", ll)
    k = F.col("parameters")
    return fits.withColumns({"aic": 2 * k - 2 * F.col("log_likelihood"), "bic": k * F.log(n) - 2 * F.col("log_likelihood")})


def rank_sums(df: DataFrame, key: str, group: str, first: str, second: str, x: str, slots: int = 64) -> DataFrame:
    """Mann-Whitney's U of two groups for each key: n_a, n_b, u (pairs in which the first is larger, ties half), ties (sum of t^3 - t), z with the variance corrected for ties.

    Rows are first summed to distinct values. Ranks are running sums over values within ranges of hashed-together equal
    values: ranges are cut at quantiles of each key, and their sums, one row a range, are added, so that no key is one task.
    """
    known = df.filter(F.col(group).isin(first, second) & F.col(x).isNotNull()).select(key, F.col(x).cast("double").alias("_v"), (F.col(group) == first).cast("bigint").alias("_a"))
    values = known.groupBy(key, "_v").agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b"))
    cuts = known.groupBy(F.col(key).alias("_of")).agg(F.percentile_approx("_v", [k / slots for k in range(1, slots)], 1000).alias("_cuts"))
    # The cuts only share out the work: any cuts give the same ranks, as equal values always fall in one range.
    ranged = values.join(cuts, F.col(key).eqNullSafe(F.col("_of"))).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", "_of")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(key, "_range").agg(F.sum(F.col("a") + F.col("b")).alias("_n")).select(F.col(key).alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("a") + F.col("b")
    ranked = ranged.withColumn("_upto", F.sum(t).over(within)).join(offsets, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    rank = F.col("_before") + F.col("_upto") - (t - 1) / 2
    n_a, n_b = F.sum("a"), F.sum("b")
    sums = ranked.groupBy(key).agg(n_a.alias("n_a"), n_b.alias("n_b"), F.sum(F.col("a") * rank).alias("_ranks"), F.sum(t.cast("double") * t * t - t).alias("ties"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    sums = sums.withColumn("u", F.col("_ranks") - a * (a + 1) / 2)
    n = a + b
    variance = a * b / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    return sums.withColumn("z", F.try_divide(F.col("u") - a * b / 2, F.sqrt(F.greatest(variance, F.lit(0.0))))).drop("_ranks")


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi squared of independence of two columns: n, chi2, df and Cramer's V. Rows with a null in either are left out."""
    cells = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(F.col(rows).alias("_r"), F.col(columns).alias("_c")).agg(F.count(F.lit(1)).alias("o"))
    of = lambda c: cells.groupBy(c).agg(F.sum("o").alias(f"_n{c}"))
    r, c = of("_r"), of("_c")
    size = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    # sum of o^2 / e - n runs over cells that occur only
    total = cells.agg(F.sum("o").alias("n"))
    parts = cells.join(r, "_r").join(c, "_c").agg(F.sum(F.col("o") / F.col("_n_r") * F.col("o") / F.col("_n_c")).alias("s"))
    one = total.crossJoin(parts).crossJoin(size(r, "k")).crossJoin(size(c, "l"))  # one row each
    chi2 = F.col("n") * (F.col("s") - 1)
    least = F.least("k", "l") - 1
    return one.select("n", chi2.alias("chi2"), ((F.col("k") - 1) * (F.col("l") - 1)).alias("df"), F.sqrt(F.try_divide(chi2, F.col("n") * least)).alias("cramers_v"))
