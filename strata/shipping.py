"""Making this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors when PYTHONPATH doesn't already say where it is. Spark copies the file itself, so it
    may lie in the driver's own temporary folder.
    """
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_strata_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strata-ship-"), "strata_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(ROOT, "strata")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._strata_shipped = True
