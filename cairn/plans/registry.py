"""The queries and their SQL statements, filled by ``query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a callable (spark, sf_dir) -> DataFrame, with the DuckDB SQL of the same rows if there is one."""

    def add(run):
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
