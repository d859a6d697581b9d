"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application; afterwards workers can import the package wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    archive = Path(tempfile.mkdtemp(prefix="weft-package-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
