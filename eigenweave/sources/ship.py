"""Make this package importable by Spark's Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once, unless the workers' path has its folder."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="eigenweave-")) / "eigenweave-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(p for p in (ROOT / "eigenweave").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
