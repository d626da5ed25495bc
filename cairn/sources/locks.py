"""Blobs that may not be altered before a date, canaries, and quarantine."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs

# Fixed value: what a canary file says.
CANARY_NAME, CANARY = "cairn-canary.txt", b"cairn canary: do not modify\n"


LOCK = "key string, mode string, retain_until long, legal_hold boolean"


class LockedStore:
    """Blobs below a folder with a table of locks (key, mode, retain_until in seconds, legal_hold). The lock is kept by this class; a
    store that can't lock is asked for one in vain."""

    def __init__(self, spark: SparkSession, folder: str, can_lock: bool = True):
        self.spark, self.folder, self.can_lock = spark, blobs.local_path(folder), can_lock
        self.table = f"{self.folder}/.locks"

    def locks(self) -> DataFrame:
        """key, mode, retain_until, legal_hold: the last lock of each key. Each change is a table of its own, so none is rewritten."""
        versions = [f"file://{self.table}/{v}" for v in sorted(os.listdir(self.table))] if os.path.isdir(self.table) else []
        if not versions:
            return self.spark.createDataFrame([], LOCK)
        every = self.spark.read.schema(LOCK + ", version long").parquet(*versions)
        last = F.max_by(F.struct("mode", "retain_until", "legal_hold"), "version").alias("x")
        return every.groupBy("key").agg(last).select("key", "x.*")

    def set_lock(self, keys: list[str] | DataFrame, lock: dict) -> None:
        """Longer locks stay: a date can be moved ahead only, as long as the mode is compliance."""
        if not self.can_lock:
            raise NotImplementedError("this store has no locks")
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        keys, until = keys.select("key").distinct(), lock.get("retain_until")
        shorter = self.locks().filter((F.col("mode") == "compliance") & (F.coalesce("retain_until", F.lit(0)) > (until or 0))).join(keys, "key", "left_semi").first()
        if shorter:
            raise PermissionError(f"{shorter.key} is locked until {shorter.retain_until}")
        version = len(os.listdir(self.table)) if os.path.isdir(self.table) else 0
        values = [F.lit(lock["mode"]).alias("mode"), F.lit(until).cast("long").alias("retain_until"), F.lit(bool(lock.get("legal_hold"))).alias("legal_hold"), F.lit(version).cast("long").alias("version")]
        keys.select("key", *values).write.parquet(f"file://{self.table}/{version:09d}")

    def write_once(self, rows: DataFrame, lock: dict | None) -> None:
        """Writes rows (key, data) and locks their keys."""
        if lock and not self.can_lock:
            raise NotImplementedError("this store has no locks")
        blobs.put_blobs(rows, self.folder)
        if lock:
            self.set_lock(rows, lock)

    def delete(self, keys: DataFrame, now: int) -> DataFrame:
        """Deletes what isn't locked at ``now``; the rows that stay."""
        held = self.locks().filter(F.col("legal_hold") | (F.coalesce("retain_until", F.lit(0)) > now)).select("key")
        blobs.delete_blobs(keys.join(held, "key", "left_anti"), self.folder)
        return keys.join(held, "key", "left_semi").select(*keys.columns)


def deploy_canary(folder: str) -> str:
    """The canary's path; written if it isn't there."""
    path = os.path.join(blobs.local_path(folder), CANARY_NAME)
    if not os.path.exists(path):
        blobs.put_file(path, CANARY)
    return path


def altered_canaries(files: DataFrame) -> DataFrame:
    """Of ``files`` (key, data), the canaries that say something else."""
    return files.filter((F.substring_index("key", "/", -1) == CANARY_NAME) & (F.col("data") != F.lit(CANARY))).select("key")


def quarantine(anomalies: DataFrame, source: str, target: str) -> int:
    """Writes anomalies (path, kind, entropy, threshold) as a JSON manifest and copies their files; the number of copies. A file that
    can't be copied is left out, as the manifest names it anyway."""
    source, target = blobs.local_path(source), blobs.local_path(target)
    anomalies.write.mode("overwrite").json(f"file://{target}/manifest")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for path in batch.column(0).to_pylist():
                to = os.path.join(target, "files", path)
                try:
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    shutil.copyfile(os.path.join(source, path), to)
                    done += 1
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return anomalies.select("path").distinct().mapInArrow(copy, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
