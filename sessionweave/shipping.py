"""The package on the executors: Python workers import it from a zip that Spark hands out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def ship(spark: SparkSession) -> None:
    """Once for each context: a cluster's workers have neither the driver's folder nor its path."""
    context = spark.sparkContext
    if getattr(context, "_has_sessionweave", False):
        return
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="sessionweave-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/sessionweave.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as to:
        for file in sorted(package.rglob("*.py")):
            to.write(file, str(Path(package.name) / file.relative_to(package)))
    context.addPyFile(path)
    context._has_sessionweave = True


def shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
