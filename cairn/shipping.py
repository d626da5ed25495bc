"""Makes this package importable for Spark's Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Nothing to do where PYTHONPATH has the package's folder, as workers inherit it. Else workers on this machine get it by their
    environment, and others a copy by Spark's file server. Once for each context."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_cairn_shipped", False):
        return
    context._cairn_shipped = True
    if context.master.startswith("local["):
        context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [context.environment.get("PYTHONPATH")])])
    else:
        with tempfile.TemporaryDirectory() as folder:
            context.addPyFile(shutil.make_archive(f"{folder}/cairn", "zip", ROOT, "cairn"))
