"""Byte entropy, anomalies and trust."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes sampled, the entropy that is an anomaly, and the trust rule's weights.
SAMPLE, HIGH_ENTROPY = 256 << 10, 7.5
ALPHA, FULL_DEVIATION, LEAST_TRUST, RECENT = 0.2, 4.0, 0.4, 8


def byte_entropy(raw: bytes | memoryview) -> float:
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum()) + 0.0


def with_entropy(files: DataFrame, data: str, out: str = "entropy", sample: int = SAMPLE) -> DataFrame:
    """Adds Shannon entropy (bits a byte) of the first ``sample`` bytes; 0 for an empty file, null for a null one. Bytes are
    counted where they are read: no shuffle."""
    keep = [c for c in files.columns if c not in (data, out)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [byte_entropy(c.as_buffer()) if c.is_valid else None for c in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*keep, out])

    schema = T.StructType([*(f for f in files.schema.fields if f.name in keep), T.StructField(out, T.DoubleType())])
    return files.select(*keep, F.substring(F.col(data), 1, sample).alias(data)).mapInArrow(of, schema)


def anomalies(files: DataFrame, threshold: float, canary: Column) -> DataFrame:
    """path, kind, entropy, threshold: files of high entropy, and canaries (a condition on files) that were altered."""
    none = F.lit(None).cast("double")
    kinds = [(F.col("entropy") >= threshold, "HighEntropy", F.col("entropy"), F.lit(float(threshold))), (canary, "CanaryModified", none, none)]
    found = [F.when(c, F.struct(F.lit(kind).alias("kind"), e.alias("entropy"), t.alias("threshold"))) for c, kind, e, t in kinds]
    return files.select("path", F.inline(F.array_compact(F.array(*found))))  # files are read once for both


def _score(x: Column, baseline: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(x - baseline) / FULL_DEVIATION))


#: Measurements that one task folds into one step.
FOLD = 512


def trust(series: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """baseline, samples, score, suspicious of the last measurement of each key.

    The baseline moves first (0.8 of it and 0.2 of the measurement; the first measurement is the first baseline), then the
    deviation is taken. A run of measurements acts on the baseline as b -> a * b + c, so runs of FOLD are folded beside each
    other and then the runs themselves; no key is gathered whole.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = series.select(*key, F.col(value).alias("x"), F.row_number().over(w).cast("long").alias("i"))
    # The first measurement replaces whatever was before.
    now = rows.select(*key, (F.col("i") - 1).alias("i"), F.when(F.col("i") == 1, 0.0).otherwise(1 - ALPHA).alias("a"), F.when(F.col("i") == 1, F.col("x")).otherwise(ALPHA * F.col("x")).alias("c"))
    last = rows.groupBy(*key).agg(F.max_by("x", "i").alias("x"), F.max("i").alias("samples"))
    left = last.agg(F.max("samples")).first()[0] or 1  # one number: how many rounds
    while True:
        steps = F.array_sort(F.collect_list(F.struct("i", "a", "c")))
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
        fold = F.aggregate(steps, start, lambda s, t: F.struct((s["a"] * t["a"]).alias("a"), (t["a"] * s["c"] + t["c"]).alias("c")))
        now = now.groupBy(*key, F.floor(F.col("i") / FOLD).alias("g")).agg(fold.alias("f")).select(*key, F.col("g").alias("i"), "f.a", "f.c")
        left = -(-left // FOLD)
        if left <= 1:
            break
    out = now.select(*key, F.col("c").alias("baseline")).join(last, key)
    score = _score(F.col("x"), F.col("baseline"))
    return out.select(*key, "baseline", "samples", score.alias("score"), (score < LEAST_TRUST).alias("suspicious"))


def percent(processed_bytes: Column, total_bytes: Column, processed_files: Column, total_files: Column) -> Column:
    """Whole percent by bytes, else by files, else 100."""
    by = lambda a, b: (F.least(a, b) * 100 / b).cast("int")
    return F.when(total_bytes > 0, by(processed_bytes, total_bytes)).when(total_files > 0, by(processed_files, total_files)).otherwise(100)


def progress(files: DataFrame, job: list[str], order: list[str], size: str) -> DataFrame:
    """Running processed files and bytes of each job, with the percent."""
    w = Window.partitionBy(*job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    all_ = files.groupBy(*job).agg(F.count(F.lit(1)).alias("total_files"), F.sum(size).alias("total_bytes"))
    run = files.withColumn("processed_files", F.count(F.lit(1)).over(w)).withColumn("processed_bytes", F.sum(size).over(w)).join(all_, job)
    return run.withColumn("percent", percent(F.col("processed_bytes"), F.col("total_bytes"), F.col("processed_files"), F.col("total_files")))
