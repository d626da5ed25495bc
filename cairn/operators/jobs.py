"""Jobs and agents as folds over event logs, and schedules."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds of silence after which an agent is offline and a running job has failed.
AGENT_SILENCE, JOB_SILENCE = 300, 86_400
STATUSES = ["Pending", "Assigned", "InProgress", "Completed", "Failed"]


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs whose time has come, earliest first."""
    return jobs.filter((F.col("status") == "Pending") & (F.col("scheduled_time") <= now)).orderBy("scheduled_time", "id")


def claim(jobs: DataFrame, now: Column, agent: str, most: int) -> DataFrame:
    """The jobs with the first ``most`` due ones assigned to the agent."""
    taken = due(jobs, now).limit(most).select("id", F.lit(True).alias("__taken"))
    both = jobs.join(taken, "id", "left")
    return both.withColumn("status", F.when(F.col("__taken"), "Assigned").otherwise(F.col("status"))).withColumn("agent_id", F.when(F.col("__taken"), agent).otherwise(F.col("agent_id"))).drop("__taken")


def with_stale(jobs: DataFrame, now: Column, silence: int = JOB_SILENCE) -> DataFrame:
    """Jobs in progress for too long have failed."""
    old = (F.col("status") == "InProgress") & F.col("started_at").isNotNull() & (F.col("started_at") <= now - silence)
    return jobs.withColumn("error_message", F.when(old, "Job timed out").otherwise(F.col("error_message"))).withColumn("status", F.when(old, "Failed").otherwise(F.col("status")))


def latest_progress(updates: DataFrame, job: str, order: list[str], value: str) -> DataFrame:
    return updates.groupBy(job).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("updates"))


#: What may follow each status; anything else is refused.
NEXT = {"Pending": ["Assigned"], "Assigned": ["InProgress", "Completed", "Failed"], "InProgress": ["Completed", "Failed"], "Completed": [], "Failed": []}


def folded(events: DataFrame, job: str, order: list[str], status: str) -> DataFrame:
    """``status`` of each job after its events in order, from Pending, and how many were refused. A job has few events."""
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(status).alias("__to")))), lambda e: e["__to"])
    start = F.struct(F.lit("Pending").alias("status"), F.lit(0).cast("long").alias("refused"))

    def step(a: Column, to: Column) -> Column:
        ok = F.array_contains(F.element_at(allowed, a["status"]), to)
        return F.struct(F.when(ok, to).otherwise(a["status"]).alias("status"), (a["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    return events.groupBy(job).agg(F.aggregate(listed, start, step).alias("__s")).select(job, "__s.status", "__s.refused")


def agent_status(registry: DataFrame, beats: DataFrame, now: Column, silence: int = AGENT_SILENCE) -> DataFrame:
    """Registered agents (agent_id) with their last beat and Online or Offline; beats of unknown agents are void."""
    last = beats.groupBy("agent_id").agg(F.max("beat").alias("last_beat"))
    both = registry.join(last, "agent_id", "left")
    return both.withColumn("status", F.when(F.col("last_beat").isNull() | (now - F.col("last_beat") > silence), "Offline").otherwise("Online"))


# --- schedules --------------------------------------------------------------------------------------------------


def _field(text: str, lo: int, hi: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = (f"{lo}-{hi}" if span == "*" else span).partition("-")
        first, last = int(a), int(b) if b else (hi if step else int(a))
        if not lo <= first <= last <= hi:
            raise ValueError(f"bad schedule field: {text}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


def cron_times(schedule: str, after: int, until: int) -> Iterator[int]:
    """Epoch seconds in (after, until] of a schedule "second minute hour day month weekday" (or without seconds), in UTC. Where
    both day and weekday are given, either does. Weekday 0 or 7 is Sunday."""
    parts = schedule.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) != 6:
        raise ValueError(f"bad schedule: {schedule}")
    seconds, minutes, hours, days, months = (_field(p, a, b) for p, (a, b) in zip(parts, [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12)]))
    weekdays = {w % 7 for w in _field(parts[5], 0, 7)}
    day = datetime.fromtimestamp(after, timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    while day.timestamp() <= until:
        by_day, by_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        hit = (by_day or by_week) if parts[3] != "*" and parts[5] != "*" else by_day and by_week
        if hit and day.month in months:
            base = int(day.timestamp())
            for h in sorted(hours):
                for m in sorted(minutes):
                    for s in sorted(seconds):
                        t = base + 3600 * h + 60 * m + s
                        if after < t <= until:
                            yield t
        day += timedelta(days=1)


def run_schedules(templates: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(templates with next_run advanced, new Pending jobs): a template (id, schedule_cron, next_run) whose time has come emits one
    job, however many runs were missed; one without next_run gets its first."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        year = 366 * 86_400  # a 29 February comes again after eight years at most
        for pdf in parts:
            rows = []
            for r in pdf.itertuples():
                upcoming = lambda t: next(cron_times(r.schedule_cron, t, t + 9 * year), None)  # noqa: B023, E731
                at = None if pd.isna(r.next_run) else int(r.next_run)
                fires = at is not None and now >= at
                rows.append((r.id, r.schedule_cron, upcoming(now) if fires or at is None else at, fires, at if fires else None))
            yield pd.DataFrame(rows, columns=["id", "schedule_cron", "next_run", "fires", "scheduled_time"]).astype({"next_run": "Int64", "scheduled_time": "Int64"})

    both = templates.select("id", "schedule_cron", "next_run").mapInPandas(step, "id string, schedule_cron string, next_run long, fires boolean, scheduled_time long")
    jobs = both.filter("fires").select(F.concat_ws("@", "id", F.col("scheduled_time").cast("string")).alias("id"), F.lit("Pending").alias("status"), "scheduled_time")
    return both.drop("fires", "scheduled_time"), jobs


def decoded(rows: DataFrame) -> DataFrame:
    """Jobs from stored rows: JSON columns read, statuses checked, seconds as timestamps."""
    known = F.col("status").isin(STATUSES)
    return rows.withColumns({
        "source_paths": F.from_json("source_paths", "array<string>"),
        "parameters": F.from_json("parameters", "map<string,string>"),
        "scheduled_time": F.timestamp_seconds("scheduled_time"),
        "status": F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.col("status")))),
    })


def encoded(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({"source_paths": F.to_json("source_paths"), "parameters": F.to_json("parameters"), "scheduled_time": F.unix_seconds("scheduled_time")})
