"""Entropy of documents, anomalies, trust in users' series, and restore progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly
from .files import file_bytes
from .registry import query, table

_ENTROPY = """SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE e END AS entropy FROM (SELECT d.doc_id, octet_length(encode(text)) AS n, e FROM documents d LEFT JOIN (
  SELECT doc_id, -sum(c / t * log2(c / t)) AS e FROM (SELECT doc_id, b, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS t
  FROM (SELECT doc_id, substr(h, i * 2 + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, least(length(h) // 2, 262144))) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))) GROUP BY 1, 2) GROUP BY 1) USING (doc_id))"""


@query("file_entropy", f"SELECT doc_id, round(entropy, 6) AS entropy FROM ({_ENTROPY})")
def file_entropy(spark, sf_dir):
    return anomaly.with_entropy(file_bytes(spark, sf_dir).select("doc_id", "data"), "data").select("doc_id", F.round("entropy", 6).alias("entropy"))


_PATH = "concat_ws('/', source, lang, doc_id::VARCHAR)"


@query("entropy_anomalies", f"""SELECT {_PATH} AS path, 'HighEntropy' AS kind, round(entropy, 6) AS entropy, 4.6::DOUBLE AS threshold FROM documents JOIN ({_ENTROPY}) USING (doc_id) WHERE entropy >= 4.6
  UNION ALL SELECT {_PATH}, 'CanaryModified', NULL, NULL FROM documents WHERE doc_id % 100 = 7""")
def entropy_anomalies(spark, sf_dir):
    files = anomaly.with_entropy(file_bytes(spark, sf_dir), "data")
    found = anomaly.anomalies(files, 4.6, F.col("doc_id") % 100 == 7)
    return found.withColumn("entropy", F.round("entropy", 6))


@query("detection_verdict", f"""SELECT source, count(*)::BIGINT AS files, count_if(entropy >= 4.6)::BIGINT AS high, round(avg(entropy), 6) AS mean, CASE WHEN count_if(entropy >= 4.6) > 0 THEN 'Suspicious' ELSE 'Clean' END AS verdict
  FROM documents JOIN ({_ENTROPY}) USING (doc_id) GROUP BY 1""")
def detection_verdict(spark, sf_dir):
    files = anomaly.with_entropy(file_bytes(spark, sf_dir).withColumn("source", F.split("path", "/")[0]), "data")
    out = files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("entropy") >= 4.6).alias("high"), F.round(F.avg("entropy"), 6).alias("mean"))
    return out.withColumn("verdict", F.when(F.col("high") > 0, "Suspicious").otherwise("Clean"))


TRUST_SQL = """SELECT user_id, round(b, 6) AS baseline, n::BIGINT AS samples, round(greatest(0.0, least(1.0, 1 - abs(x - b) / 4)), 6) AS score, greatest(0.0, least(1.0, 1 - abs(x - b) / 4)) < 0.4 AS suspicious
  FROM (SELECT user_id, list_reduce(list(value ORDER BY ts, event_id), lambda a, v: a * 0.8 + v * 0.2) AS b, arg_max(value, (ts, event_id)) AS x, count(*) AS n FROM events GROUP BY 1)"""


@query("trust_ewma", TRUST_SQL)
def trust_ewma(spark, sf_dir):
    out = anomaly.trust(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("user_id", F.round("baseline", 6).alias("baseline"), "samples", F.round("score", 6).alias("score"), "suspicious")


@query("restore_progress", """SELECT o_custkey, o_orderkey, row_number() OVER w AS processed_files, sum(size) OVER w::BIGINT AS processed_bytes, (sum(size) OVER w * 100 // sum(size) OVER (PARTITION BY o_custkey))::INT AS percent
  FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS size FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def restore_progress(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("size"))
    return anomaly.progress(files, ["o_custkey"], ["o_orderkey"], "size").select("o_custkey", "o_orderkey", "processed_files", "processed_bytes", "percent")
