"""Each query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import pytest

from cairn.plans.catalog import ORACLE, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in want.description}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert got == rows
    assert rows, "a query without rows shows nothing"


def test_queries_without_sql_have_rows(spark, sf):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, sf).count() > 0


def test_cdc_covers_the_files(spark, sf):
    from pyspark.sql import functions as F

    sizes = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    chunks = QUERIES["cdc_chunks"](spark, sf).groupBy("doc_id").agg(F.sum("chunk_len").alias("sum"))
    assert sizes.join(chunks, "doc_id").filter("size <> sum").count() == 0


def test_zstd_frames_round_trip(spark, sf):
    rows = QUERIES["zstd_frame_roundtrip"](spark, sf).collect()
    assert all(r.equal and r.status == "ok" for r in rows) and sum(r.stored for r in rows) < sum(r.size for r in rows)


def test_plans_prune_columns_and_push_filters(spark, sf):
    plan = QUERIES["orphan_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,48.0)" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
