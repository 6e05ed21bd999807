"""What a running Spark session needs from this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for functions that run in their Python."""
    sc = spark.sparkContext
    if getattr(sc, "_weir_shipped", None) == sc.applicationId:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="weir-ship-"), "weir.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(path)
    sc._weir_shipped = sc.applicationId
