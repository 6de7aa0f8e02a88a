"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the workers once an application, unless their PYTHONPATH holds it."""
    context, package = spark.sparkContext, Path(__file__).parent
    root = str(package.parent)
    if context.applicationId in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver until then
    path = f"{folder}/{package.name}-sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
