"""Closure of the object tree: what is reachable from given roots, with a visited set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch_dir


def reachable(roots: DataFrame, edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(root, object_id) pairs, each once: ``roots`` (root, object_id) and all that ``edges`` (parent, child) lead to.

    Breadth first: each level is written to the shared folder and holds what no earlier level has, so cycles end and shared
    objects count once. Edges are written once, whatever they are derived from. The driver sees one truth value a level.
    """
    spark, at = roots.sparkSession, scratch_dir(roots.sparkSession)
    schema = "root " + roots.schema["root"].dataType.simpleString() + ", object_id " + roots.schema["object_id"].dataType.simpleString()
    roots.select("root", "object_id").distinct().write.parquet(f"{at}/level=0")
    steps = edges.select("parent", "child")
    steps.write.parquet(f"{at}/edges")
    edges = spark.read.schema(steps.schema).parquet(f"{at}/edges")
    for level in range(most_levels):
        seen = spark.read.schema(schema).parquet(*[f"{at}/level={k}" for k in range(level + 1)])
        now = spark.read.schema(schema).parquet(f"{at}/level={level}")
        if now.isEmpty():
            return seen
        found = now.join(edges, F.col("object_id") == F.col("parent")).select("root", F.col("child").alias("object_id")).distinct()
        found.join(seen, ["root", "object_id"], "left_anti").write.parquet(f"{at}/level={level + 1}")
    raise ValueError("the tree is deeper than most_levels")


def tree_sizes(closure: DataFrame, objects: DataFrame) -> DataFrame:
    """Files and bytes below each root. ``objects``: object_id, type, size; directories and fingerprints have no size."""
    sized = closure.join(objects, "object_id").filter("type in ('File', 'BlockDevice')")
    return sized.groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
