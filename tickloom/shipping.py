"""Sends this package to the executors' Python workers, which may not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context, however the package was found here; the driver alone reads the file, Spark passes it on."""
    context = spark.sparkContext
    if getattr(context, "_tickloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="tickloom-package-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    target = f"{own}/tickloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._tickloom_shipped = True
