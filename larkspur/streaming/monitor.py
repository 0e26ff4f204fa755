"""Running figures over streams of evaluation rows. Batch frames go through the same plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larkspur.operators.windows import upsert


def running_figures(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and model: rows, accuracy, mean latency and cost. Rows later than ``late`` behind the newest are left out of closed windows."""
    timed = rows.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg("latency_ms").alias("latency"), F.sum("cost_usd").alias("cost")
    ).select(F.col("w.start").alias("start"), "model_id", "n", "accuracy", "latency", "cost")


def distinct_rows(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each evaluation once, however often it arrives within the watermark."""
    return rows.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["eval_id"])


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of rows of a model without a pause of more than ``gap``."""
    timed = rows.withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "model_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "model_id", "n")


def upserting_parts(path: str, keys: list[str], parts: int = 64):
    """As ``upserting``, but keys are spread over parts by their hash, and a batch rewrites only parts that it has rows for; ``newest_parts`` reads the table. A batch that comes again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        if number:
            touched = new.select("part").distinct()  # as many rows as there are parts, at most
            old = newest_parts(spark, path, before=number, schema=new.schema).join(F.broadcast(touched), "part", "left_semi")
            new = upsert(old, new, keys)
        # each part in a task of its own; parts of earlier versions stay in place for readers
        new.withColumn("version", F.lit(number)).repartition(parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(path)

    return write


def newest_parts(spark, path: str, before: int | None = None, schema=None) -> DataFrame:
    """The newest version of each part, below a number if one is given; with a schema, an empty table is one without rows."""
    table = spark.read.schema(StructType([*schema.fields, StructField("version", IntegerType())])).parquet(path) if schema else spark.read.parquet(path)
    versions = table.select("part", "version").distinct() if before is None else table.filter(F.col("version") < before).select("part", "version").distinct()
    heads = versions.groupBy("part").agg(F.max("version").alias("version"))  # one row a part
    return table.join(F.broadcast(heads), ["part", "version"]).drop("version")


def upserting(path: str, keys: list[str]):
    """A foreachBatch function that keeps the newest row of each key in a Parquet table of numbered versions."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if number:
            new = upsert(spark.read.parquet(f"{path}/v{number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write
