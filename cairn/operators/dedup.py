"""References from snapshots to chunks, and files that haven't changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_references(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """The references with those of ``rows``; a pair counts once."""
    return refs.unionByName(rows.select(*refs.columns)).dropDuplicates(["chunk_hash", "snapshot_id"])


def drop_snapshots(refs: DataFrame, snapshots: list) -> DataFrame:
    return refs.filter(~F.col("snapshot_id").isin(snapshots))


def refcounts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("refcount"))


def newly_unreferenced(refs: DataFrame, dropped: Column) -> DataFrame:
    """Chunks of which every reference is from a snapshot that ``dropped`` (a condition) holds for."""
    both = refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(dropped).alias("n_dropped"))
    return both.filter("n = n_dropped").select("chunk_hash", "n")


def orphans(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunks without a reference."""
    return chunks.join(refs.select(F.col("chunk_hash").alias("hash")), "hash", "left_anti")


def with_existence(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``wanted`` (hash, ...) with ``exists``."""
    known = chunks.select("hash", F.lit(True).alias("exists")).dropDuplicates(["hash"])
    return wanted.join(known, "hash", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def stats(refs: DataFrame) -> DataFrame:
    by_hash = refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"))
    whole = by_hash.agg(F.count(F.lit(1)).alias("unique_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_references"))
    snapshots = refs.select("snapshot_id").distinct().agg(F.count(F.lit(1)).alias("snapshots"))
    return whole.crossJoin(F.broadcast(snapshots))  # one row each


def unchanged(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """Current files (path, mtime, size) that the tracker has with the same three, with the chunk list they had."""
    return current.join(tracked.select("path", "mtime", "size", "chunks"), ["path", "mtime", "size"])


def changed(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """Current files to be read again."""
    return current.join(tracked.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def record(tracked: DataFrame, rows: DataFrame) -> DataFrame:
    """The tracker with the states of ``rows`` in the place of those of their paths."""
    return tracked.join(rows.select("path"), "path", "left_anti").select(*rows.columns).unionByName(rows)
