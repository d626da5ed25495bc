"""Connected components of links, by alternating large-star and small-star (Kiveris et al., 2014).

Only frames of links move; the driver sees one truth value a round. A star's centre may hold a third of all links: minima are
pre-aggregated, and the join back can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .common import small as few


def _star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each node's neighbours and itself (u, v), with the least of them as m.

    The minima are written, so that the join is one of two tables: by broadcast while they are few, else one whose hot keys
    adaptive execution splits."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return links.join(few(scratch.keep(least, name)), F.col("u") == F.col("w")).select("u", "v", "m")


def _is_star(links: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root on another."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) for each node of ``links`` (a, b: long) that is not its own root; root is the component's least node.

    Links may repeat, point either way or from a node to itself; those with a null are void. No links: no rows.
    """
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, k = scratch.keep(now, f"{name}-0"), 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scratch, f"{name}-large-{k}").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large, scratch, f"{name}-small-{k}")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now, k = scratch.keep(small.filter(F.col("u") != F.col("v")).distinct(), f"{name}-{k + 1}"), k + 1
        scratch.drop(f"{name}-{k - 1}", f"{name}-large-{k - 1}", f"{name}-small-{k - 1}")
        if _is_star(now):
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
