"""Making this package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def importable_by_workers() -> bool:
    """Workers started by this process find the package by the path or the working folder they inherit."""
    return str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's files, once, unless workers find it anyway."""
    application = spark.sparkContext.applicationId
    if application not in _shipped and not importable_by_workers():
        path = Path(tempfile.mkdtemp(prefix="package-"), "actionflow.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(ROOT.joinpath("actionflow").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(application)
    return spark
