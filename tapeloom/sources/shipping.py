"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application, as ``--py-files`` would; harmless where they have it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="tapeloom-")) / "tapeloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
