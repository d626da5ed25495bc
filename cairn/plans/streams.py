"""Streams over the driver's tables, drained and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from ..streaming import folds
from .dedup import chunks
from .jobs import NOW, OFFLINE_SQL, PROGRESS_SQL, beats, registry
from .analytics import TRUST_SQL
from .registry import query, table


def _stream(spark, sf_dir, name):
    """The table as a stream of its files."""
    whole = table(spark, sf_dir, name)
    return spark.readStream.schema(whole.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("stream_heartbeat", OFFLINE_SQL)
def stream_heartbeat(spark, sf_dir):
    last = folds.drained(spark, folds.last_beats(beats(_stream(spark, sf_dir, "events"))), "update")
    return jobs.agent_status(registry(spark, sf_dir), last, F.lit(NOW))


@query("stream_progress", PROGRESS_SQL)
def stream_progress(spark, sf_dir):
    updates = _stream(spark, sf_dir, "events").withColumn("percent", F.get_json_object("props", "$.k").cast("long"))
    out = folds.drained(spark, folds.latest_progress(updates, "user_id", ["ts", "event_id"], "percent"), "update")
    return out.groupBy("user_id").agg(F.max_by("percent", "batch").alias("percent"), F.max("updates").alias("updates"))


@query("stream_trust", TRUST_SQL)
def stream_trust(spark, sf_dir):
    states = folds.drained(spark, folds.trust(_stream(spark, sf_dir, "events")), "update")
    return folds.scored(states).select("user_id", F.round("baseline", 6).alias("baseline"), "samples", F.round("score", 6).alias("score"), "suspicious")


@query("stream_chunk_exists", 'SELECT o_orderkey AS hash, EXISTS (SELECT 1 FROM part WHERE p_partkey = o_orderkey) AS "exists" FROM orders')
def stream_chunk_exists(spark, sf_dir):
    wanted = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"))
    return folds.drained(spark, folds.known_chunks(wanted, chunks(spark, sf_dir)), "append").select("hash", "exists")
