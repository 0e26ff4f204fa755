"""Stored results: saved runs, appended tables, cached results, listings and codebooks."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.load import SUFFIXES, flattened, format_of
from larkspur.sources.scratch import remove


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_results(df: DataFrame, path: str, kind: str = "both", config: dict | None = None, metadata: dict | None = None) -> None:
    """Results as Parquet, JSON lines or both, beside a row with configuration, metadata and a summary."""
    if kind not in ("parquet", "json", "both"):
        raise ValueError(f"no format named {kind}")
    if kind != "json":
        df.write.mode("overwrite").parquet(f"{path}/results.parquet")
    if kind != "parquet":
        df.write.mode("overwrite").json(f"{path}/results.json")
    about = df.agg(F.lit(json.dumps(config or {})).alias("config"), F.lit(json.dumps(metadata or {})).alias("metadata"), F.count(F.lit(1)).alias("results"))
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about.json")


def load_results(spark: SparkSession, path: str, bodies: tuple[str, ...] = ("problem",)) -> DataFrame:
    """Saved results without their problem bodies, from Parquet where there is one."""
    for name, read in (("results.parquet", spark.read.parquet), ("results.json", spark.read.json)):
        target, fs = _fs(spark, f"{path}/{name}")
        if fs.exists(target):
            return read(f"{path}/{name}").drop(*bodies)
    raise FileNotFoundError(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a stored table."""
    df.write.mode("append").parquet(path)


class ResultCache:
    """Results by the md5 of a name and its arguments; beyond ``most`` of them those not used for longest go."""

    def __init__(self, spark: SparkSession, root: str, most: int = 1000):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    def get(self, name: str, make: Callable[[], DataFrame], **arguments) -> DataFrame:
        key = hashlib.md5(f"{name}:{json.dumps(arguments, sort_keys=True, default=str)}".encode()).hexdigest()
        place, fs = _fs(self.spark, f"{self.root}/{key}")
        if not fs.exists(_fs(self.spark, f"{self.root}/{key}/_SUCCESS")[0]):
            make().write.mode("overwrite").parquet(f"{self.root}/{key}")
        fs.setTimes(place, int(time.time() * 1000), -1)
        kept = sorted(fs.listStatus(place.getParent()), key=lambda s: s.getModificationTime())
        for status in kept[: max(0, len(kept) - self.most)]:
            remove(self.spark, status.getPath().toString())
        return self.spark.read.parquet(f"{self.root}/{key}")


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """name and format of every dataset in a folder, by known suffixes."""
    target, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return spark.createDataFrame([(n.rpartition(".")[0], format_of(n)) for n in sorted(names) if n.endswith(tuple(SUFFIXES))], "name string, format string")


def codebook(df: DataFrame, meaning: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, values that are there, and what it means."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{k}").alias("present"), F.lit((meaning or {}).get(c, "")).alias("meaning")) for k, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, size_bytes and sha256 of each file of an export, by which a copy can be checked; a task reads a file whole, so files are meant to be of an export's usual size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def content_lock(*columns: str) -> Column:
    """The digest of a row's values as JSON in the order of names, nulls included, to show later that none was changed."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def export_csv(df: DataFrame, path: str) -> None:
    """A flat CSV with a header, nested cells as JSON."""
    flattened(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
