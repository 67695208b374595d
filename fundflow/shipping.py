"""Makes the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="fundflow-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, f"{root.name}/{source.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
