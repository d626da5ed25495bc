"""Jobs (orders) and agents (users of events, suppliers), at a fixed time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from .registry import query, table

NOW = 1_704_326_400  # 2024-01-04 00:00:00 UTC

_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'InProgress' ELSE 'Completed' END"
_JOBS = f"SELECT o_orderkey AS id, {_STATUS} AS status, floor(epoch(o_orderdate))::BIGINT AS scheduled_time FROM orders"
#: A time in the middle of the orders' dates.
MIDDLE = 883_612_800  # 1998-01-01


def job_table(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "P", "InProgress").otherwise("Completed")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), at.alias("scheduled_time"), F.when(status == "InProgress", at).alias("started_at"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("agent_id"))


@query("job_due", f"SELECT id, scheduled_time FROM ({_JOBS}) WHERE status = 'Pending' AND scheduled_time <= {MIDDLE}")
def job_due(spark, sf_dir):
    return jobs.due(job_table(spark, sf_dir), F.lit(MIDDLE)).select("id", "scheduled_time")


@query("job_claim", f"SELECT id, CASE WHEN rn <= 25 THEN 'Assigned' ELSE status END AS status, CASE WHEN rn <= 25 THEN 'agent-1' END AS agent_id FROM (SELECT * FROM ({_JOBS})) LEFT JOIN (SELECT id, row_number() OVER (ORDER BY scheduled_time, id) AS rn FROM ({_JOBS}) WHERE status = 'Pending' AND scheduled_time <= {MIDDLE}) USING (id)")
def job_claim(spark, sf_dir):
    return jobs.claim(job_table(spark, sf_dir), F.lit(MIDDLE), "agent-1", 25).select("id", "status", "agent_id")


@query("job_stale", f"SELECT id, CASE WHEN status = 'InProgress' AND scheduled_time <= {MIDDLE} - 86400 THEN 'Failed' ELSE status END AS status, CASE WHEN status = 'InProgress' AND scheduled_time <= {MIDDLE} - 86400 THEN 'Job timed out' END AS error_message FROM ({_JOBS})")
def job_stale(spark, sf_dir):
    return jobs.with_stale(job_table(spark, sf_dir), F.lit(MIDDLE)).select("id", "status", "error_message")


PROGRESS_SQL = "SELECT user_id, arg_max((props::JSON->>'k')::BIGINT, (ts, event_id)) AS percent, count(*)::BIGINT AS updates FROM events GROUP BY 1"


@query("job_latest_progress", PROGRESS_SQL)
def job_latest_progress(spark, sf_dir):
    updates = table(spark, sf_dir, "events").withColumn("percent", F.get_json_object("props", "$.k").cast("long"))
    return jobs.latest_progress(updates, "user_id", ["ts", "event_id"], "percent")


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_id % 5 WHEN 0 THEN 'Assigned' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Failed' ELSE 'Pending' END AS s FROM events),
  f AS (SELECT user_id, 0::BIGINT AS i, 'Pending' AS status, 0::BIGINT AS refused FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT f.user_id, e.i, CASE WHEN ok THEN s ELSE status END, refused + (NOT ok)::INT FROM (SELECT f.*, e.s, e.i AS j, ((f.status = 'Pending' AND e.s = 'Assigned') OR (f.status = 'Assigned' AND e.s IN ('InProgress', 'Completed', 'Failed')) OR (f.status = 'InProgress' AND e.s IN ('Completed', 'Failed'))) AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) f JOIN e ON e.user_id = f.user_id AND e.i = f.j)
  SELECT user_id, arg_max(status, i) AS status, max(refused)::BIGINT AS refused FROM f GROUP BY 1""".replace("CASE WHEN ok THEN s ELSE status END", "CASE WHEN ok THEN f.s ELSE status END")


@query("job_state_fold", _FOLD)
def job_state_fold(spark, sf_dir):
    names = F.array(*map(F.lit, ["Assigned", "InProgress", "Completed", "Failed", "Pending"]))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.get(names, (F.col("event_id") % 5).cast("int")).alias("to"))
    return jobs.folded(events, "user_id", ["ts", "event_id"], "to")


OFFLINE_SQL = f"""SELECT s_suppkey AS agent_id, b AS last_beat, CASE WHEN b IS NULL OR {NOW} - b > 300 THEN 'Offline' ELSE 'Online' END AS status FROM supplier LEFT JOIN
  (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS b FROM events WHERE ts < to_timestamp({NOW}) AT TIME ZONE 'UTC' GROUP BY 1) ON user_id = s_suppkey"""


def registry(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("agent_id"))


def beats(events):
    return events.select(F.col("user_id").alias("agent_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("beat")).filter(F.col("beat") < NOW)


@query("agent_offline", OFFLINE_SQL)
def agent_offline(spark, sf_dir):
    return jobs.agent_status(registry(spark, sf_dir), beats(table(spark, sf_dir, "events")), F.lit(NOW))


@query("job_decode", """SELECT id, n_paths::BIGINT AS n_paths, mode, scheduled FROM (VALUES ('a', 2, 'full', '2023-11-14 22:13:20'), ('b', 0, NULL, '1970-01-01 00:00:00')) t(id, n_paths, mode, scheduled)""")
def job_decode(spark, sf_dir):
    rows = spark.createDataFrame([("a", '["/x","/y"]', '{"mode":"full"}', 1_700_000_000, "Pending"), ("b", "[]", "{}", 0, "Failed")], "id string, source_paths string, parameters string, scheduled_time long, status string")
    out = jobs.decoded(jobs.encoded(jobs.decoded(rows)))
    return out.select("id", F.size("source_paths").cast("long").alias("n_paths"), F.try_element_at("parameters", F.lit("mode")).alias("mode"), F.date_format("scheduled_time", "yyyy-MM-dd HH:mm:ss").alias("scheduled"))


@query("cron_runs", """SELECT * FROM (VALUES ('daily', 1704412800::BIGINT, 1704326400::BIGINT), ('hourly', 1704330000, 1704250000), ('later', 1704400000, NULL), ('new', 1704326700, NULL)) t(id, next_run, emitted)""")
def cron_runs(spark, sf_dir):
    rows = [("daily", "0 0 0 * * *", NOW), ("hourly", "0 * * * *", 1_704_250_000), ("later", "0 0 * * *", 1_704_400_000), ("new", "*/5 * * * *", None)]
    templates, made = jobs.run_schedules(spark.createDataFrame(rows, "id string, schedule_cron string, next_run long"), NOW)
    made = made.select(F.split("id", "@")[0].alias("id"), F.col("scheduled_time").alias("emitted"))
    return templates.select("id", "next_run").join(made, "id", "left")
