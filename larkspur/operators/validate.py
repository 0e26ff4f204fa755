"""Constraints as counts of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """For each named SQL condition, how many rows break it (a null result does not count)."""
    one = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def missing_fields(df: DataFrame, document: str, fields: list[str]) -> DataFrame:
    """For each required field, in how many JSON documents of a column it is absent; a null or malformed document has none."""
    keys = F.json_object_keys(document)
    one = df.select(keys.alias("keys")).agg(*[F.count_if(~F.coalesce(F.array_contains("keys", f), F.lit(False))).alias(f"n{k}") for k, f in enumerate(fields)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{k}").alias("missing")) for k, f in enumerate(fields)])))


def over_limit(df: DataFrame, subject: Column, value: str, limit: float, severity: str, category: str) -> DataFrame:
    """An issue for each row whose value is above the limit; nulls pass."""
    return df.filter(F.col(value) > limit).select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), subject.alias("subject"), F.col(value).cast("double").alias("value"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per named check with the number of its rows."""
    rows = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("rule"), "violations") for n, df in parts.items()]
    return reduce(DataFrame.unionAll, rows)
