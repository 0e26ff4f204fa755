"""Sums of vectors by key that numpy computes from rows, and counted values in order: what fits over continuous columns are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that a task holds before it passes its sums on.
HELD = 4_000_000
#: Keys whose state may come to the driver between the steps of a fit.
MOST_KEYS = 2000


def _gathered(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches joined until they hold so many rows. Those whose columns differ in type, as integers with nulls do, stay apart."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if held and (sum(map(len, held)) >= rows or (frame.dtypes != held[0].dtypes).any()):
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def keyed_sums(df: DataFrame, keys: list[str], make: Callable[[tuple, pd.DataFrame], np.ndarray], rows: int = 0) -> DataFrame:
    """Per key the sum (column ``sums``, an array) of the vectors that ``make`` gives for batches of the key's rows; batches are joined to so many rows first, over all keys.

    A task adds up its batches and passes on a vector for each key it met, so a hot key is spread over all tasks; with
    more keys than it may hold it passes them on early. Entries are then summed with map-side combining.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        numbers = 0

        def passed() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=[*keys, "sums"])
            held.clear()
            return out

        for frame in _gathered(frames, rows):
            for name, part in frame.groupby(keys, sort=False, dropna=False):
                name = tuple(None if pd.isna(k) else k for k in name)
                found = make(name, part)
                numbers += 0 if name in held else len(found)
                held[name] = held[name] + found if name in held else found
            if numbers > HELD:
                yield passed()
                numbers = 0
        if held:
            yield passed()

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    entries = df.mapInPandas(fold, f"{fields}, sums array<double>").select(*keys, F.posexplode("sums").alias("_at", "_v"))
    added = entries.groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    return added.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda e: e["_v"]).alias("sums"))


def by_key(df: DataFrame, key: str) -> dict:
    """Rows of a table of one row a key, on the driver. Raises ValueError for more than MOST_KEYS keys."""
    rows = df.limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"a fit by {key} holds its state for {MOST_KEYS} keys at most")
    return {r[key]: r for r in rows}


def row_quantiles(df: DataFrame, key: str, x: str, shares: list[float], slots: int = 64) -> DataFrame:
    """Per key the array ``quantiles``: for each share the least value of x that so large a share of the rows does not exceed. Exact, and the same at every scale of the counts.

    Values are counted first. Their running counts are taken within ranges cut at approximate quantiles, which only
    share out the work, and ranges are then added, so that no key is one task.
    """
    known = df.filter(F.col(x).isNotNull()).select(key, F.col(x).cast("double").alias("_x"))
    cuts = known.groupBy(F.col(key).alias("_of")).agg(F.percentile_approx("_x", [k / slots for k in range(1, slots)], 1000).alias("_cuts"), F.count(F.lit(1)).alias("_rows"))
    values = known.groupBy(key, "_x").agg(F.count(F.lit(1)).alias("_n")).join(cuts, F.col(key).eqNullSafe(F.col("_of")))
    ranged = values.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts", "_of")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(key, "_range").agg(F.sum("_n").alias("_n")).select(F.col(key).alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_within", F.sum("_n").over(within)).join(offsets, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    share = (F.col("_before") + F.col("_within")) / F.col("_rows")
    least = [F.min(F.when(share >= q - 1e-12, F.col("_x"))) for q in shares]
    return placed.groupBy(key).agg(F.array(*least).alias("quantiles"), F.max("_rows").alias("n"))
