"""Folds over several batches give what one batch gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import anomaly
from cairn.streaming import folds

SCHEMA = "event_id long, ts timestamp, user_id long, value double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    """Three files, a day each."""
    r = random.Random(9)
    rows = [(i, START + dt.timedelta(minutes=17 * i), r.randrange(4), r.uniform(0, 8)) for i in range(240)]
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_trust_over_batches(spark, events):
    got = {r.user_id: (r.baseline, r.samples, r.score) for r in folds.scored(folds.drained(spark, folds.trust(stream(spark, events)), "update")).collect()}
    batch = anomaly.trust(spark.read.parquet(events), ["user_id"], ["ts", "event_id"], "value").collect()
    assert got == {r.user_id: (pytest.approx(r.baseline), r.samples, pytest.approx(r.score)) for r in batch}


def test_progress_and_beats_over_batches(spark, events):
    out = folds.drained(spark, folds.latest_progress(stream(spark, events), "user_id", ["ts", "event_id"], "value"), "update")
    assert out.select("batch").distinct().count() == 3
    last = {r.user_id: (r.v, r.n) for r in out.groupBy("user_id").agg(F.max_by("value", "batch").alias("v"), F.max("updates").alias("n")).collect()}
    want = spark.read.parquet(events).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), F.count("*").alias("n")).collect()
    assert last == {r.user_id: (r.v, r.n) for r in want}
    beats = stream(spark, events).select(F.col("user_id").alias("agent_id"), F.unix_timestamp("ts").alias("beat"))
    got = folds.drained(spark, folds.last_beats(beats), "update").groupBy("agent_id").agg(F.max("beat").alias("beat")).collect()
    assert {r.agent_id: r.beat for r in got} == {r.user_id: r.m for r in spark.read.parquet(events).groupBy("user_id").agg(F.max(F.unix_timestamp("ts")).alias("m")).collect()}


def test_spells_end_with_silence(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(1, at(0)), (1, at(3)), (1, at(20)), (2, at(1)), (3, at(500))]
    spark.createDataFrame(rows, "agent_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/b")
    found = folds.silent_spells(spark.readStream.schema("agent_id long, ts timestamp").parquet(f"{tmp_path}/b"), "ts")
    got = folds.drained(spark, found, "append").collect()
    assert sorted((r.agent_id, r.beats, r.end) for r in got) == [(1, 1, at(25)), (1, 2, at(8)), (2, 1, at(6))]


def test_known_chunks(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "hash string").coalesce(1).write.parquet(f"{tmp_path}/h")
    known = spark.createDataFrame([("a",), ("a",)], "hash string")
    got = folds.drained(spark, folds.known_chunks(spark.readStream.schema("hash string").parquet(f"{tmp_path}/h"), known), "append").collect()
    assert sorted((r.hash, r.exists) for r in got) == [("a", True), ("a", True), ("b", False)]
