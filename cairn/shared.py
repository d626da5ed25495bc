"""The folder that the driver and all executors share, and tables and files below it."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

#: Where a session on one machine keeps what a cluster keeps in spark.checkpoint.dir.
LOCAL = "file:///tmp/checkpoints/cairn"


def shared_dir(spark: SparkSession) -> str:
    """The session's or the context's spark.checkpoint.dir. Only a local master may do without; elsewhere a folder that is not shared
    would lose what other executors wrote, so that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_dir(spark: SparkSession, label: str = "closure") -> str:
    """A name for a new folder in the shared one; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def close() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return

    atexit.register(close)
    return path
