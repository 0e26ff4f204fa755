"""Ranking, queues and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same keys."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, keys, F.desc("_v")).drop("_v")


def stratified(df: DataFrame, stratum: str, identity: str, total: int, seed: str = "0") -> DataFrame:
    """``total`` rows shared equally over strata, the remainder to the first ones by name; within a stratum rows go by the md5 of seed and identity."""
    sizes = df.select(stratum).distinct().withColumns({"_k": F.row_number().over(Window.orderBy(stratum)), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    quota = F.floor(F.lit(total) / F.col("_m")) + (F.col("_k") <= total % F.col("_m")).cast("int")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(identity))), identity))
    # no quota exceeds the total: a constant limit lets every task rank only that many rows of a stratum before the shuffle
    ranked = df.withColumn("_n", place).filter(F.col("_n") <= total)
    return ranked.join(sizes.select(stratum, quota.alias("_q")), stratum).filter("_n <= _q").drop("_n", "_q")


def running_totals(df: DataFrame, key: str, slot: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums up to each row of a key, in the given order. ``slot`` must not fall along that order; rows are sorted within a
    key's slot only, and what came before is added from the table of slots, so that a hot key is not one task."""
    names = list(sums)
    rows = df.withColumn("_slot", slot).withColumns({f"_{n}": c for n, c in sums.items()})
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_at")).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    slots = slots.select("_key", "_at", *[F.sum(f"_{n}").over(before).alias(f"_before_{n}") for n in names])
    within = Window.partitionBy(key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_{n}": F.sum(f"_{n}").over(within) for n in names})
    joined = rows.join(slots, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slot").eqNullSafe(F.col("_at")))
    total = lambda n: F.coalesce(F.col(f"_{n}") + F.col(f"_before_{n}"), F.col(f"_{n}"), F.col(f"_before_{n}"))
    return joined.withColumns({n: total(n) for n in names}).drop("_slot", "_key", "_at", *[f"_{n}" for n in names], *[f"_before_{n}" for n in names])


def sessions(df: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    """Runs of rows of a key without a pause of so many minutes or more: start, end (with the pause) and n. Rows of one clock slot of
    that length are always of one run, so only slots, summed before the shuffle, are sorted."""
    gap = minutes * 60_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    slots = df.filter(F.col(time).isNotNull()).groupBy(key, F.floor(at / gap).alias("_slot")).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(key).orderBy("_slot")
    opens = F.coalesce(F.col("_low") - F.lag("_high").over(w) >= gap, F.lit(True)).cast("int")
    runs = slots.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.timestamp_micros(F.min("_low")).alias("start"), F.timestamp_micros(F.max("_high") + gap).alias("end"), F.sum("_rows").alias("n")).drop("_run")


def ready(status: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries whose dependencies are all completed, with how many they have. status: id, state; edges: id, needs."""
    done = status.filter("state = 'completed'").select(F.col("id").alias("needs"), F.lit(1).alias("_done"))
    counts = edges.join(done, "needs", "left").groupBy("id").agg(F.count(F.lit(1)).alias("dependencies"), F.count("_done").alias("met"))
    all_ = status.join(counts, "id", "left").fillna(0, ["dependencies", "met"])
    return all_.filter("dependencies = met and state != 'completed'").select("id", "dependencies")
