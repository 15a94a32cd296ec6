"""Ships this package to the executors, so that functions that run there can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "parlance_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-ship-"), "parlance.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    # rows may hold long texts: keep the batches that Python workers get small, in rows and in bytes,
    # unless the session has limits of its own
    for key, default, small in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", small)
    context.parlance_shipped = True
