"""Stateful folds over streams. Each takes a streaming frame and returns one, to be written in update mode."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.anomaly import ALPHA, FULL_DEVIATION, LEAST_TRUST
from ..shared import scratch_dir


def latest_progress(updates: DataFrame, job: str, order: list[str], value: str) -> DataFrame:
    """The last value of each job so far, and how many updates it had."""
    return updates.groupBy(job).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("updates"))


def last_beats(beats: DataFrame) -> DataFrame:
    """Largest beat of each agent so far. Whether that is too old is for the reader, who has the time."""
    return beats.groupBy("agent_id").agg(F.max("beat").alias("beat"))


def silent_spells(beats: DataFrame, time: str, silence: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells of each agent without a pause longer than ``silence``, once the watermark has passed their end."""
    spells = beats.withWatermark(time, late).groupBy("agent_id", F.session_window(time, silence).alias("w"))
    return spells.agg(F.count(F.lit(1)).alias("beats")).select("agent_id", "w.start", "w.end", "beats")


def known_chunks(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """A stream of hashes, each with whether the table has it."""
    known = chunks.select("hash", F.lit(True).alias("exists")).dropDuplicates(["hash"])
    return wanted.join(known, "hash", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


_TRUST = "user_id long, baseline double, samples long, x double"


def _observe(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    baseline, samples, x = state.get if state.exists else (None, 0, None)
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for x in rows["value"]:
        x = float(x)
        baseline = x if baseline is None else (1 - ALPHA) * baseline + ALPHA * x
        samples += 1
    state.update((baseline, samples, x))
    yield pd.DataFrame({"user_id": [key[0]], "baseline": [baseline], "samples": [samples], "x": [x]})


def trust(events: DataFrame) -> DataFrame:
    """baseline and samples of each user after the events so far. Events of a user must come in order between batches."""
    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(_observe, _TRUST, "baseline double, samples long, x double", "update", GroupStateTimeout.NoTimeout)


def scored(states: DataFrame) -> DataFrame:
    """The verdict of the last state of each user."""
    last = states.groupBy("user_id").agg(F.max_by(F.struct("baseline", "x"), "samples").alias("s"), F.max("samples").alias("samples"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("s.x") - F.col("s.baseline")) / FULL_DEVIATION))
    return last.select("user_id", F.col("s.baseline").alias("baseline"), "samples", score.alias("score"), (score < LEAST_TRUST).alias("suspicious"))


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what there is and returns all rows it emitted, with the batch they came in.

    Batches are written whole under their number, so a batch that is tried again replaces itself.
    """
    at = scratch_dir(spark) + uuid.uuid4().hex
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    out = spark.read.schema(schema.add("batch", "long")).option("basePath", f"{at}/out").parquet(f"{at}/out")
    return out
