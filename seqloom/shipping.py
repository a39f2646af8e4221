"""Send this package to the executors, so that Python workers can import it on any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Register the package's sources with the session's application, once each."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
