"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    # a file of the driver alone: Spark copies it to wherever a task runs
    path = os.path.join(tempfile.mkdtemp(prefix="sentloom-"), "sentloom.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
