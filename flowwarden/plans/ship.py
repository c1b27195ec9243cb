"""Hands the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once; Python workers import it from there."""
    sc = spark.sparkContext
    name = f"{os.path.basename(PACKAGE)}.zip"
    if any(str(path).endswith(name) for path in getattr(sc, "_python_includes", [])):
        return
    target = os.path.join(tempfile.mkdtemp(), name)
    root = os.path.dirname(PACKAGE)
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(PACKAGE):
            for f in sorted(files):
                if f.endswith(".py"):
                    out.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    sc.addPyFile(target)
