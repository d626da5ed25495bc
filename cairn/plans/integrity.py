"""Merkle roots of sources, logs of users, verification of chunks, layouts of orders' extents, and authenticated encryption."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.hashing import digest
from ..operators import catalog, integrity
from ..operators.chunking import split_extents
from .files import file_bytes
from .registry import query, table

KEY = bytes([9]) * 32


def _leaves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", digest(F.col("text")).alias("node"))
    return catalog.ordered_ranks(docs, ["source"], ["doc_id"], "i")


_LEAVES = "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, sha256(text) AS node, doc_id FROM documents"
_TREE = f"""RECURSIVE t AS (SELECT source, 0 AS lvl, i, sha256(unhex('00') || unhex(node)) AS h, count(*) OVER (PARTITION BY source) AS n FROM ({_LEAVES})
  UNION ALL SELECT source, lvl + 1, i // 2, CASE WHEN r IS NULL THEN h ELSE sha256(unhex('01') || unhex(h) || unhex(r)) END, (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY source ORDER BY i) AS r FROM t WHERE n > 1) WHERE i % 2 = 0)"""


@query("merkle_root", f"WITH {_TREE} SELECT source, max(h) AS root, (SELECT count(*) FROM documents d WHERE d.source = t.source)::BIGINT AS leaves FROM t WHERE n = 1 GROUP BY source")
def merkle_root(spark, sf_dir):
    return integrity.merkle_roots(_leaves(spark, sf_dir), ["source"], "i", "node")


@query("merkle_diff", f"SELECT source, i::BIGINT AS i FROM ({_LEAVES}) WHERE doc_id % 13 = 0 OR source = 'src1'")
def merkle_diff(spark, sf_dir):
    """Every thirteenth leaf altered, and one of src1 lost: all its places then differ."""
    good = _leaves(spark, sf_dir)
    bad = good.withColumn("node", F.when(F.col("doc_id") % 13 == 0, F.lit("00" * 32)).otherwise(F.col("node"))).filter("not (source = 'src1' and i = 0)")
    return integrity.merkle_diff(good, bad, ["source"], "i", "node")


def _message():
    return F.concat_ws("|", F.lit("1"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "event_type", F.col("user_id").cast("string"), "props")


_INNER = "".join(f"{b ^ 0x36:02x}" for b in KEY.ljust(64, b"\0"))
_OUTER = "".join(f"{b ^ 0x5C:02x}" for b in KEY.ljust(64, b"\0"))
_SIGN = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(%s))))"
_LOG = "SELECT event_id, user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, '1|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_type || '|' || user_id || '|' AS head FROM events"
_CHAIN = f"""RECURSIVE log AS ({_LOG}), c AS (SELECT event_id, user_id, idx, head, props, '' AS prev, {_SIGN % "head || props || '|'"} AS sig FROM log WHERE idx = 0
  UNION ALL SELECT l.event_id, l.user_id, l.idx, l.head, l.props, c.sig, {_SIGN % "l.head || l.props || '|' || c.sig"} FROM c JOIN log l ON l.user_id = c.user_id AND l.idx = c.idx + 1)"""


def _chain(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return integrity.signed_chain(events, ["user_id"], ["ts", "event_id"], _message(), KEY)


@query("history_chain", f"WITH {_CHAIN} SELECT event_id, user_id, idx::BIGINT AS idx, prev AS prev_signature, sig AS signature FROM c")
def history_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("event_id", "user_id", "idx", "prev_signature", "signature")


@query("history_verify", f"""WITH {_CHAIN}, kept AS (SELECT *, lag(sig, 1, '') OVER (PARTITION BY user_id ORDER BY idx) AS want FROM c WHERE event_id % 89 <> 0)
  SELECT event_id, idx::BIGINT AS idx, prev <> want AS broken, event_id % 97 = 0 AS tampered FROM kept WHERE prev <> want OR event_id % 97 = 0""")
def history_verify(spark, sf_dir):
    """Some lines altered, some deleted: which the chain tells."""
    bad = _chain(spark, sf_dir).withColumn("props", F.when(F.col("event_id") % 97 == 0, F.lit("{}")).otherwise(F.col("props"))).filter("event_id % 89 <> 0")
    return integrity.verified_chain(bad, ["user_id"], _message(), KEY).filter("broken or tampered").select("event_id", "idx", "broken", "tampered")


@query("history_head", f"WITH {_CHAIN} SELECT user_id, arg_max(sig, idx) AS head, count(*)::BIGINT AS entries FROM c GROUP BY 1")
def history_head(spark, sf_dir):
    return _chain(spark, sf_dir).groupBy("user_id").agg(F.max_by("signature", "idx").alias("head"), F.count(F.lit(1)).alias("entries"))


_STATUS = """SELECT hash, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'empty' WHEN doc_id % 17 = 0 THEN 'altered' ELSE 'ok' END AS status
  FROM (SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY 1)"""


def _verified(spark, sf_dir):
    once = file_bytes(spark, sf_dir).filter("octet_length(data) > 0").select(digest(F.col("data")).alias("hash"), "doc_id", "data")
    once = once.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.first("data").alias("data"))
    data = F.when(F.col("doc_id") % 13 == 0, F.lit(b"")).when(F.col("doc_id") % 17 == 0, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    return integrity.chunk_status(once.select("hash"), once.filter("doc_id % 11 <> 0").select("hash", data.alias("data")))


@query("verify_chunks", _STATUS)
def verify_chunks(spark, sf_dir):
    return _verified(spark, sf_dir)


@query("verify_summary", f"SELECT status, count(*)::BIGINT AS n FROM ({_STATUS}) GROUP BY 1")
def verify_summary(spark, sf_dir):
    return _verified(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_ONE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1"


def _lines(spark, sf_dir):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1")


@query("extent_split", f"SELECT l_orderkey, l_linenumber, i::INT AS piece, (l_partkey * 100 + i * 7)::BIGINT AS piece_offset, least(7, q - i * 7)::BIGINT AS piece_len FROM (SELECT *, unnest(range(0, (q - 1) // 7 + 1)) AS i FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q FROM ({_ONE})))")
def extent_split(spark, sf_dir):
    extents = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    return split_extents(extents, "offset", "length", 7).select("l_orderkey", "l_linenumber", "piece", "piece_offset", "piece_len")


_EXTENTS = f"""SELECT l_orderkey AS object_id, l_linenumber::BIGINT AS extent_idx, (l_linenumber * 60 - 20 * (l_partkey % 17 = 0)::INT)::BIGINT AS extent_offset, l_quantity::BIGINT AS extent_len, (440 - 60 * (l_orderkey % 19 = 0)::INT)::BIGINT AS device FROM ({_ONE})"""
_PIECES = f"""SELECT object_id, extent_idx, i::BIGINT AS chunk_idx, (i * 20 + (object_id % 23 = 0 AND i = 1)::INT)::BIGINT AS rel_offset, (least(20, extent_len - i * 20) - (object_id % 29 = 0 AND i = 0)::INT)::BIGINT AS chunk_len FROM (SELECT *, unnest(range(0, (extent_len - 1) // 20 + 1)) AS i FROM ({_EXTENTS}))"""


def _layout(spark, sf_dir):
    """Extents of at most 50 bytes every 60, cut by 20; some overlap, some are past the end, some chunks have gaps."""
    lines = _lines(spark, sf_dir)
    extents = lines.select(
        F.col("l_orderkey").alias("object_id"),
        F.col("l_linenumber").cast("long").alias("extent_idx"),
        (F.col("l_linenumber") * 60 - F.when(F.col("l_partkey") % 17 == 0, 20).otherwise(0)).cast("long").alias("extent_offset"),
        F.col("l_quantity").cast("long").alias("extent_len"),
        (F.lit(440) - F.when(F.col("l_orderkey") % 19 == 0, 60).otherwise(0)).cast("long").alias("device"),
    )
    pieces = split_extents(extents.withColumn("zero", F.lit(0)), "zero", "extent_len", 20)
    chunks = pieces.select(
        "object_id",
        "extent_idx",
        F.col("piece").cast("long").alias("chunk_idx"),
        (F.col("piece_offset") + F.when((F.col("object_id") % 23 == 0) & (F.col("piece") == 1), 1).otherwise(0)).alias("rel_offset"),
        (F.col("piece_len") - F.when((F.col("object_id") % 29 == 0) & (F.col("piece") == 0), 1).otherwise(0)).alias("chunk_len"),
    )
    return extents, chunks


@query("block_layout", f"SELECT object_id, extent_idx, extent_len, c.n::BIGINT AS n_chunks, c.s::BIGINT AS bytes, c.l AS lens FROM ({_EXTENTS}) LEFT JOIN (SELECT object_id, extent_idx, count(*) AS n, sum(chunk_len) AS s, string_agg(chunk_len::VARCHAR, ',' ORDER BY chunk_idx) AS l FROM ({_PIECES}) GROUP BY 1, 2) c USING (object_id, extent_idx)")
def block_layout(spark, sf_dir):
    extents, chunks = _layout(spark, sf_dir)
    nested = catalog.block_layout(extents, chunks.withColumn("chunk_hash", F.lit("")))
    lens = F.transform("chunks", lambda c: c["chunk_len"])
    return nested.select("object_id", "extent_idx", "extent_len", F.size("chunks").cast("long").alias("n_chunks"), F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"), F.array_join(F.transform(lens, lambda x: x.cast("string")), ",").alias("lens"))


@query("layout_violations", f"""WITH e AS (SELECT *, lag(extent_offset + extent_len) OVER (PARTITION BY object_id ORDER BY extent_idx) AS before FROM ({_EXTENTS})),
  p AS (SELECT *, coalesce(sum(chunk_len) OVER (PARTITION BY object_id, extent_idx ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want FROM ({_PIECES})),
  c AS (SELECT object_id, extent_idx, sum(chunk_len) AS s, count_if(want <> rel_offset) AS gaps FROM p GROUP BY 1, 2), a AS (SELECT * FROM e LEFT JOIN c USING (object_id, extent_idx))
  SELECT object_id, extent_idx, 'no length' AS error FROM a WHERE extent_len <= 0 UNION ALL SELECT object_id, extent_idx, 'overlap' FROM a WHERE extent_offset < before
  UNION ALL SELECT object_id, extent_idx, 'past the end' FROM a WHERE extent_offset + extent_len > device UNION ALL SELECT object_id, extent_idx, 'chunks not in a row' FROM a WHERE coalesce(gaps, 0) > 0
  UNION ALL SELECT object_id, extent_idx, 'chunks do not fill' FROM a WHERE coalesce(s, 0) <> extent_len""")
def layout_violations(spark, sf_dir):
    extents, chunks = _layout(spark, sf_dir)
    return integrity.extent_errors(extents, chunks, "device")


DATA_KEY, EPOCH = hashlib.sha256(b"data").digest(), 7


@query("aead_roundtrip", "SELECT doc_id, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS size, (octet_length(encode(text)) + 21)::BIGINT AS stored, true AS equal, doc_id % 3 = 0 AS refused FROM documents WHERE text <> ''")
def aead_roundtrip(spark, sf_dir):
    """Chunks sealed with a nonce from their hash, opened again; every third is altered first and must be refused."""
    files = file_bytes(spark, sf_dir).filter("octet_length(data) > 0").withColumn("hash", digest(F.col("data")))
    sealed = files.withColumn("sealed", crypto.seal_chunk(F.col("data"), F.col("hash"), DATA_KEY, EPOCH))
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("sealed", 1, F.octet_length("sealed") - 1), F.lit(b"\x00\x01")))
    back = sealed.withColumn("back", crypto.open_chunk(F.col("sealed"), F.col("hash"), {EPOCH: DATA_KEY}))
    refused = broken.isNotNull() & crypto.open_chunk(broken, F.col("hash"), {EPOCH: DATA_KEY}).isNull()
    return back.select("doc_id", "hash", F.octet_length("data").cast("long").alias("size"), F.octet_length("sealed").cast("long").alias("stored"), F.coalesce(F.col("back") == F.col("data"), F.lit(False)).alias("equal"), refused.alias("refused"))


@query("derived_nonces", f"SELECT doc_id, substr(sha256(unhex(sha256(text)) || unhex('07000000')), 1, 24) AS nonce FROM documents")
def derived_nonces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lower(F.hex(crypto.nonce(digest(F.col("text")), EPOCH))).alias("nonce"))
