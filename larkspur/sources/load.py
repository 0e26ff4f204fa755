"""Loading and converting datasets of several formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".orc": "orc"}
#: Names under which a JSON object may hold its rows, in order of precedence.
ROW_FIELDS = ("data", "examples", "instances", "items")
_loaders: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_loader(kind: str, load: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add or replace the loader of a format."""
    _loaders[kind] = load


def format_of(path: str) -> str:
    return next((kind for suffix, kind in SUFFIXES.items() if path.rstrip("/").endswith(suffix)), "json")


def resolve(spark: SparkSession, name: str, folders: tuple[str, ...] = ()) -> str:
    """The path itself if it exists, else the name in one of the folders, with or without a known suffix. Raises FileNotFoundError."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for top in ("", *[f"{f.rstrip('/')}/" for f in folders]):
        for suffix in ("", *SUFFIXES):
            path = jvm.org.apache.hadoop.fs.Path(f"{top}{name}{suffix}")
            if path.getFileSystem(conf).exists(path):
                return f"{top}{name}{suffix}"
    raise FileNotFoundError(name)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of rows, an object that holds one under a known name, or one row."""
    df = spark.read.option("multiLine", "true").json(path)
    for field in ROW_FIELDS:
        if dict(df.dtypes).get(field, "").startswith("array<struct"):
            return df.select(F.inline(field))
    return df


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row a line; blank and malformed lines are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; the delimiter is the one most frequent in the header."""
    header = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    separator = max(",;\t|", key=header.count)
    return spark.read.option("header", "true").option("sep", separator).option("multiLine", "true").option("escape", '"').csv(path)


def json_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that begin with { or [ and parse as JSON become variants; others keep a null variant beside the text."""
    looks = lambda c: F.rlike(F.col(c), F.lit(r"^\s*[\[{]"))
    return df.withColumns({f"{c}_json": F.when(looks(c), F.try_parse_json(c)) for c in columns})


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with their numbers from 0, found per file split by byte order and offset by the lines before it."""
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).alias("_part")
    lines = lines.select("value", "_id", part)
    counts = lines.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return lines.join(before, "_part").select("value", (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("line"))


def read_dataset(spark: SparkSession, name: str, kind: str | None = None, folders: tuple[str, ...] = ()) -> DataFrame:
    """Resolve, load and validate. Raises ValueError for a dataset without rows."""
    path = resolve(spark, name, folders)
    kind = kind or format_of(path)
    builtin = {"json": read_json, "jsonl": read_jsonl, "csv": read_csv, "parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p)}
    load = _loaders.get(kind) or builtin.get(kind)
    if load is None:
        raise ValueError(f"no loader for {kind}")
    df = load(spark, path)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def info(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, and the first value cut to 100 characters."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.left(F.first(F.col(f"`{c}`").cast("string"), ignorenulls=True), F.lit(100)).alias(f"v{k}") for k, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("rows"), F.col(f"v{k}").alias("sample")) for k, (c, t) in enumerate(df.dtypes)])))


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as flat formats need them."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])


def convert(df: DataFrame, path: str, kind: str) -> None:
    writer = df.write.mode("overwrite")
    {"json": lambda: writer.json(path), "jsonl": lambda: writer.json(path), "csv": lambda: flattened(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path), "parquet": lambda: writer.parquet(path), "orc": lambda: writer.orc(path)}[kind]()
