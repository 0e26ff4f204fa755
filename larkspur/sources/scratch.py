"""Places for tables that a plan writes and reads back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(_sweep)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir, removed when the driver ends. Where that is unset, a local session gets a folder of its own and any other is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/larkspur-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path
