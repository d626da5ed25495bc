"""Which snapshots to keep, and what then is garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def with_keep(snapshots: DataFrame, keep_last: int, keep_days: int, now: int) -> DataFrame:
    """``snapshots`` (snapshot_id, timestamp in epoch seconds) with ``keep``: among the last ``keep_last``, or no older than
    ``keep_days`` days. Both 0: nothing is kept. Equal timestamps rank by id."""
    # Ranks are needed below keep_last only, so the newest are taken first instead of ranking all in one task.
    newest = snapshots.orderBy(F.desc("timestamp"), "snapshot_id").limit(keep_last).select(F.col("snapshot_id").alias("__id"), F.lit(True).alias("__new"))
    young = (F.col("timestamp") >= now - keep_days * DAY) if keep_days > 0 else F.lit(False)
    return snapshots.join(newest, F.col("snapshot_id") == F.col("__id"), "left").withColumn("keep", F.coalesce("__new", F.lit(False)) | young).drop("__id", "__new")


def lock(enabled: Column, days: Column, now: Column, mode: Column) -> Column:
    """Retention lock of a policy: null if it is off; without days, no date."""
    until = F.when(days > 0, now + days * DAY)
    return F.when(enabled, F.struct(mode.alias("mode"), until.alias("retain_until"), F.lit(True).alias("legal_hold")))


def patched(policy: DataFrame, patch: DataFrame) -> DataFrame:
    """Each field of ``patch`` that isn't null replaces the policy's. Both have one row."""
    return policy.select(*[F.col(c).alias(f"__{c}") for c in policy.columns]).join(patch, F.lit(True)).select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in policy.columns])


def prune_plan(chunks: DataFrame, live: DataFrame, freed: DataFrame) -> DataFrame:
    """hash and action of each chunk: ``reclaim`` if nothing live holds it, ``keep`` else; and ``free`` for hashes that only
    references of dropped snapshots name and that aren't reclaimed already."""
    marked = chunks.select("hash").join(live.select("hash", F.lit(True).alias("__live")).dropDuplicates(["hash"]), "hash", "left")
    marked = marked.select("hash", F.when(F.col("__live"), "keep").otherwise("reclaim").alias("action"))
    more = freed.select("hash").distinct().join(chunks.select("hash"), "hash", "left_anti").join(live.select("hash"), "hash", "left_anti")
    return marked.unionByName(more.select("hash", F.lit("free").alias("action")))


def rank_keep(snapshots: DataFrame, group: list[str], keep_last: int) -> DataFrame:
    """As with_keep's first rule, within groups (hosts, say)."""
    w = Window.partitionBy(*group).orderBy(F.desc("timestamp"), "snapshot_id")
    return snapshots.withColumn("keep", F.row_number().over(w) <= keep_last)
