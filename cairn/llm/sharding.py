"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's key and the number of shards alone decide its shard: no ring table, no state. With one shard more, a row
either stays or goes to the new shard, and just the share 1/(n+1) of all rows goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key. All keys jump at once until the last has landed."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), dtype=np.int64)
    ahead = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(ahead):
            state[ahead] = state[ahead] * np.uint64(2862933555777941757) + np.uint64(1)
            gap = (np.float64(1 << 31) / ((state[ahead] >> np.uint64(33)).astype(np.float64) + 1.0)) * (shard[ahead] + 1)
            lands = gap < shards
            ahead = ahead[lands]
            shard[ahead] = gap[lands].astype(np.int64)
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key."""

    @F.pandas_udf("int")
    def landed(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return landed(key)


def assign_shards(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Adds ``shard`` (of ``shards``) and ``grown_shard`` (of ``shards + 1``).

    The key is a 64-bit hash of the columns ``keys``. Null is a key value like any other; equal keys share a shard.
    Columns of these names in ``df`` are replaced. An empty table gives an empty table.
    """
    out = df.drop("shard", "grown_shard").withColumn("__key", F.xxhash64(*[F.col(k) for k in keys]))
    return out.withColumn("shard", shard_of(F.col("__key"), shards)).withColumn("grown_shard", shard_of(F.col("__key"), shards + 1)).drop("__key")


def place_in_shards(df: DataFrame, id_col: str, text_col: str, shards: int, rows: int | None = None) -> DataFrame:
    """doc id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Size is the text's UTF-8 bytes plus 16; a null text has none. Slots are gapless in each shard, by a hash of the
    id and then the id, size and checksum, so repeated rows take slots of their own; a null id is an id.
    """
    rows = df.count() if rows is None else rows
    ids = assign_shards(df.select(F.col(id_col).alias("doc_id")), ["doc_id"], shards)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    full = assign_shards(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), ["doc_id"], shards)
    ranked = gapless_rank(full, ["shard"], ["doc_id", "size", "text_crc32"], ["doc_id"], rows, "slot", per_group=max(2_000, 200_000 // shards), counts_from=ids)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, keys: list[str], shards: int, path: str, files_per_shard: int = 1) -> None:
    """Writes the whole rows into ``path/shard=N``; a shard is spread over ``files_per_shard`` files by the key's hash."""
    out = assign_shards(df, keys, shards).drop("grown_shard")
    part = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit("file")), F.lit(files_per_shard))
    out.repartition(shards * files_per_shard, "shard", part).write.mode("overwrite").partitionBy("shard").parquet(path)
