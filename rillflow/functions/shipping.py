"""Sending the package to Python workers, which may have neither the driver's search path nor its folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the session's executors, once for each Spark context. Spark fetches the archive from the driver, so nothing
    need be shared; functions then find their modules (and what these cache) in every worker."""
    sc = spark.sparkContext
    if getattr(sc, "_rillflow_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():  # else it was imported from an archive that Spark has sent already
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="rillflow")), "rillflow.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(archive)
        # workers that Spark starts beside the driver (for the schemas of stateful operators) get no files, but this environment
        paths = [sc.environment.get("PYTHONPATH", ""), str(package.parent)]
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    sc._rillflow_shipped = True
