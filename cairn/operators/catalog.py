"""Catalog tables as frames: inserts, upserts, deletes and lookups. Each returns the table as it is afterwards, or the rows asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import scratch_dir

OBJECT_TYPES = ["File", "Directory", "BlockDevice", "SystemFingerprint"]


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table doesn't have, one for each key, are added; the table's rows stay."""
    new = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of their key. ``rows`` has a key once at most (see latest)."""
    return table.join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti").select(*table.columns)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))).filter("__n = 1").drop("__n")


def with_ids(table: DataFrame, rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Gives ``rows`` the ids after the table's largest one, in order.

    Ranges of the order are written with their own numbers; the ranges' counts, one row a range, give each its first id.
    """
    spark = rows.sparkSession
    ranged = rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    at = scratch_dir(spark)
    ranged.write.parquet(at)
    kept = spark.read.schema(ranged.schema).parquet(at)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    largest = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__max"))
    starts = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    out = kept.join(F.broadcast(starts), "__p").join(F.broadcast(largest), F.lit(True))
    return out.select(*rows.columns, (F.col("__max") + F.col("__first") + F.col("__i") + 1).cast("long").alias(id_col))


def ordered_ranks(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in order within each group, however large: numbers over the whole order, less each group's first."""
    none = rows.sparkSession.range(0).select(F.col("id").alias(name))
    numbered = with_ids(none, rows, name, [*group, *order])
    first = numbered.groupBy(*group).agg(F.min(name).alias("__first"))
    return numbered.join(first, group).withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def key_violations(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def object_type(code: Column) -> Column:
    """Name of an object's type; unknown codes are files."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in OBJECT_TYPES]), F.when(code >= 0, code).otherwise(len(OBJECT_TYPES)).cast("int")), F.lit("File"))


def children(tree: DataFrame, parent: int) -> DataFrame:
    return tree.filter(F.col("parent_object_id") == parent).select("child_object_id", "encrypted_name")


def ordered_list(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``value`` as an array in the order of ``order`` for each key."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(value))


def block_layout(extents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each extent (object_id, extent_idx, extent_offset, extent_len) with the ordered array of its chunks."""
    inner = chunks.groupBy("object_id", "extent_idx").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_hash", "rel_offset", "chunk_len"))).alias("chunks"))
    return extents.join(inner, ["object_id", "extent_idx"], "left")


def stats(snapshots: DataFrame, objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the three counts."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    both = count(snapshots, "snapshots").unionByName(count(objects, "objects")).unionByName(count(chunks, "chunks"))
    return both.groupBy().pivot("what", ["snapshots", "objects", "chunks"]).agg(F.first("n"))
