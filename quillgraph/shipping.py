"""Makes the package importable in Spark's Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers through Spark, once an application, unless their PYTHONPATH has it already."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quillgraph-"), package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
