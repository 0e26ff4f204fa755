"""Sending the package to executors."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
_sending = threading.Lock()

#: Rows that go to a Python worker at once: few, as one text may be very long.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Add this package's modules to the session's Python files once, so that workers find them on any cluster, and keep its Arrow batches small."""
    context = spark.sparkContext
    with _sending:  # queries may be made in several threads
        if context.applicationId not in _sent:
            top = os.path.dirname(os.path.abspath(__file__))
            target = os.path.join(tempfile.mkdtemp(prefix="larkspur-code-"), "larkspur.zip")
            with zipfile.ZipFile(target, "w") as out:
                for folder, _, names in os.walk(top):
                    for name in sorted(names):
                        if name.endswith(".py"):
                            path = os.path.join(folder, name)
                            out.write(path, os.path.relpath(path, os.path.dirname(top)))
            context.addPyFile(target)
            _sent.add(context.applicationId)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark
