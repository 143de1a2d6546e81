"""Make the package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_inkwell_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "inkwell.zip")  # served by the driver as long as it runs
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(Path("inkwell") / p.relative_to(_PACKAGE)))
    sc.addPyFile(path)
    sc._inkwell_shipped = True
