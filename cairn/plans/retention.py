"""Snapshots (days of events, or order keys mod 50), the tree region -> nation -> customer -> order, and the prune plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as refs_op
from ..operators import graph, retention
from .dedup import all_refs, chunks
from .registry import query, table

NOW = 1_706_572_800  # 2024-01-30 00:00:00 UTC
KEEP_LAST, KEEP_DAYS = 5, 10

_DAYS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS snapshot_id, epoch(date_trunc('day', ts))::BIGINT AS timestamp, count(*)::BIGINT AS n_events FROM events GROUP BY ALL"


def days(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.date_format(day, "yyyy-MM-dd").alias("snapshot_id"), F.unix_timestamp(day).alias("timestamp")).agg(F.count(F.lit(1)).alias("n_events"))


@query("snapshot_list", f"SELECT snapshot_id, timestamp, n_events, 'id ' || snapshot_id || ' | ' || strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' | unknown' AS label FROM ({_DAYS})")
def snapshot_list(spark, sf_dir):
    date = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return days(spark, sf_dir).withColumn("label", F.concat(F.lit("id "), F.concat_ws(" | ", "snapshot_id", date, F.lit("unknown")))).orderBy(F.desc("timestamp"), "snapshot_id")


@query("retention_keep", f"""SELECT snapshot_id, timestamp, (rn <= {KEEP_LAST} OR timestamp >= {NOW - KEEP_DAYS * 86400}) AS keep FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, snapshot_id) AS rn FROM ({_DAYS}))""")
def retention_keep(spark, sf_dir):
    return retention.with_keep(days(spark, sf_dir), KEEP_LAST, KEEP_DAYS, NOW).select("snapshot_id", "timestamp", "keep")


@query("retention_lock", f"""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'governance' END AS mode, CASE WHEN s_acctbal > 0 AND s_nationkey > 0 THEN {NOW} + s_nationkey * 86400 END::BIGINT AS retain_until FROM supplier""")
def retention_lock(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("lock", retention.lock(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("long"), F.lit(NOW).cast("long"), F.lit("governance")))
    return rows.select("s_suppkey", "lock.mode", "lock.retain_until")


@query("retention_per_host", f"""SELECT s_suppkey AS snapshot_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal * 100)::BIGINT DESC, s_suppkey) <= 2 AS keep FROM supplier""")
def retention_per_host(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("snapshot_id"), "s_nationkey", F.round(F.col("s_acctbal") * 100).cast("long").alias("timestamp"))
    return retention.rank_keep(rows, ["s_nationkey"], 2).select("snapshot_id", "keep")


def _edges(spark, sf_dir):
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    top = table(spark, sf_dir, "nation").select(node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child"))
    middle = table(spark, sf_dir, "customer").select(node("n", "c_nationkey").alias("parent"), node("c", "c_custkey").alias("child"))
    low = table(spark, sf_dir, "orders").select(node("c", "o_custkey").alias("parent"), node("o", "o_orderkey").alias("child"))
    return top.unionByName(middle).unionByName(low)


_EDGES = """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


@query("tree_rollup", f"""WITH RECURSIVE e AS ({_EDGES}), t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id FROM region UNION SELECT t.root, e.child FROM t JOIN e ON e.parent = t.id)
  SELECT root, count(*)::BIGINT AS files, sum(floor(o_totalprice))::BIGINT AS bytes FROM t JOIN orders ON id = 'o' || o_orderkey GROUP BY root""")
def tree_rollup(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root")).withColumn("object_id", F.col("root"))
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("object_id"), F.lit("File").alias("type"), F.floor("o_totalprice").cast("long").alias("size"))
    return graph.tree_sizes(graph.reachable(roots, _edges(spark, sf_dir)), files)


def _kept_nations():
    return "n_nationkey % 12 = 5"


_LIVE = f"""WITH RECURSIVE e AS ({_EDGES}), t AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 12 = 5 UNION SELECT e.child FROM t JOIN e ON e.parent = t.id),
  live AS (SELECT DISTINCT l_partkey AS hash FROM lineitem JOIN t ON id = 'o' || l_orderkey)"""


def live_chunks(spark, sf_dir):
    """Chunks of the files below the nations that are kept."""
    roots = table(spark, sf_dir, "nation").filter(_kept_nations()).select(F.lit("kept").alias("root"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("object_id"))
    found = graph.reachable(roots, _edges(spark, sf_dir)).filter("object_id like 'o%'").select(F.substring("object_id", 2, 20).cast("long").alias("l_orderkey"))
    file_chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("hash"))
    return file_chunks.join(found, "l_orderkey", "left_semi").select("hash").distinct()


@query("mark_live", f"{_LIVE} SELECT hash FROM live")
def mark_live(spark, sf_dir):
    return live_chunks(spark, sf_dir)


_REFS = "SELECT DISTINCT l_partkey + 100000000 * (l_partkey % 9 = 0)::INT AS hash, l_orderkey % 50 AS snapshot_id FROM lineitem"


@query("prune_plan", f"""{_LIVE}, keep AS (SELECT snapshot_id FROM (SELECT DISTINCT l_orderkey % 50 AS snapshot_id FROM lineitem) ORDER BY snapshot_id DESC LIMIT 3),
  freed AS (SELECT hash FROM ({_REFS}) GROUP BY 1 HAVING count(*) = count_if(snapshot_id NOT IN (SELECT snapshot_id FROM keep)))
  SELECT p_partkey AS hash, CASE WHEN p_partkey IN (SELECT hash FROM live) THEN 'keep' ELSE 'reclaim' END AS action FROM part
  UNION ALL SELECT hash, 'free' FROM freed WHERE hash NOT IN (SELECT p_partkey FROM part) AND hash NOT IN (SELECT hash FROM live)""")
def prune_plan(spark, sf_dir):
    """Retention, closure, anti-join and references in one plan: what to keep, reclaim and free."""
    snapshots = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("snapshot_id")).distinct().withColumn("timestamp", F.col("snapshot_id"))
    dropped = retention.with_keep(snapshots, 3, 0, 0).filter("not keep").select("snapshot_id", F.lit(True).alias("dropped"))
    hashed = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_partkey") % 9 == 0, 100_000_000).otherwise(0)).alias("chunk_hash"), (F.col("l_orderkey") % 50).alias("snapshot_id")).distinct()
    freed = refs_op.newly_unreferenced(hashed.join(dropped, "snapshot_id", "left"), F.coalesce("dropped", F.lit(False)))
    return retention.prune_plan(chunks(spark, sf_dir), live_chunks(spark, sf_dir), freed.select(F.col("chunk_hash").alias("hash")))


@query("unreferenced_after_prune", "SELECT p_partkey AS hash FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 50 >= 45)")
def unreferenced_after_prune(spark, sf_dir):
    return refs_op.orphans(chunks(spark, sf_dir), refs_op.drop_snapshots(all_refs(spark, sf_dir), list(range(45)))).select("hash")
