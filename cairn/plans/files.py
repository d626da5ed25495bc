"""Files, chunks, manifests and trees, on the documents' texts as file bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import compressible, decode_frames, encode_frames
from ..functions.hashing import digest, shard_key
from ..operators import chunking
from .registry import query, table

CHUNK = 4096


def file_bytes(spark, sf_dir) -> DataFrame:
    """doc_id, path and data of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("data"))


def _manifest(spark, sf_dir) -> DataFrame:
    return chunking.manifest(chunking.fixed_chunks(file_bytes(spark, sf_dir), "data", CHUNK))


_CHUNKS = f"""
  SELECT doc_id, i AS ord, length(substr(h, i * {2 * CHUNK} + 1, {2 * CHUNK})) // 2 AS chunk_len, substr(h, i * {2 * CHUNK} + 1, {2 * CHUNK}) AS part
  FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 1) // {CHUNK} + 1)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''))"""
_HASHED = f"SELECT doc_id, ord, chunk_len, sha256(unhex(part)) AS hash FROM ({_CHUNKS})"


@query("fixed_chunk_manifest", f"SELECT doc_id, ord::BIGINT AS ord, chunk_len::BIGINT AS chunk_len, hash FROM ({_HASHED})")
def fixed_chunk_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).select("doc_id", "ord", "chunk_len", "hash")


@query("dedup_summary", f"""SELECT count(*)::BIGINT AS refs, count(DISTINCT hash)::BIGINT AS unique_chunks, sum(chunk_len)::BIGINT AS logical_bytes,
  (SELECT sum(n)::BIGINT FROM (SELECT hash, max(chunk_len) AS n FROM ({_HASHED}) GROUP BY hash)) AS physical_bytes FROM ({_HASHED})""")
def dedup_summary(spark, sf_dir):
    by_hash = _manifest(spark, sf_dir).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_len").alias("logical"), F.max("chunk_len").alias("physical"))
    return by_hash.agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("unique_chunks"), F.sum("logical").alias("logical_bytes"), F.sum("physical").alias("physical_bytes"))


@query("shard_histogram", f"SELECT substr(hash, 1, 2) AS shard, count(DISTINCT hash)::BIGINT AS n, min(substr(hash, 1, 2) || '/' || hash) AS first_key FROM ({_HASHED}) GROUP BY 1")
def shard_histogram(spark, sf_dir):
    once = _manifest(spark, sf_dir).select("hash").distinct()
    return once.groupBy(F.substring("hash", 1, 2).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min(shard_key(F.col("hash"))).alias("first_key"))


@query("restore_concat", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS content_hash, true AS equal FROM documents WHERE text <> ''")
def restore_concat(spark, sf_dir):
    files = file_bytes(spark, sf_dir).select("doc_id", "data")
    back = chunking.restored(chunking.fixed_chunks(files, "data", CHUNK), ["doc_id"])
    before = files.select(F.col("doc_id").alias("of"), digest(F.col("data")).alias("was"))
    return back.join(before, F.col("doc_id") == F.col("of")).select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), digest(F.col("content")).alias("content_hash"), (digest(F.col("content")) == F.col("was")).alias("equal"))


@query("verify_restored_chunks", f"""SELECT doc_id, count(*)::BIGINT AS n_chunks, count_if(doc_id % 7 = 0 AND ord = 0)::BIGINT AS n_bad FROM ({_HASHED}) GROUP BY doc_id""")
def verify_restored_chunks(spark, sf_dir):
    """Restored files, of which every seventh has a first byte more than it should, compared chunk by chunk."""
    files = file_bytes(spark, sf_dir).select("doc_id", "data")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(b"\x00"), F.substring("data", 2, 2_000_000_000))).otherwise(F.col("data"))
    found = chunking.manifest(chunking.fixed_chunks(files.withColumn("data", changed), "data", CHUNK)).select("doc_id", "ord", F.col("hash").alias("found"))
    both = _manifest(spark, sf_dir).join(found, ["doc_id", "ord"], "left")
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(~F.col("hash").eqNullSafe(F.col("found"))).alias("n_bad"))


@query("cdc_chunks")
def cdc_chunks(spark, sf_dir):
    return chunking.content_chunks(file_bytes(spark, sf_dir).select("doc_id", "data"), "data", 512, 2048, 4096)


@query("cdc_dedup")
def cdc_dedup(spark, sf_dir):
    by_hash = cdc_chunks(spark, sf_dir).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_len").alias("len"))
    return by_hash.agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("len")).alias("logical_bytes"), F.sum("len").alias("physical_bytes"))


_PARTS = "SELECT doc_id, [source, source || '/' || lang, source || '/' || lang || '/' || doc_id] AS p, octet_length(encode(text)) AS size FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL"


@query("path_tree", f"""SELECT path, CASE WHEN d = 1 THEN NULL ELSE parent END AS parent, CASE WHEN d = 3 THEN 'File' ELSE 'Directory' END AS type, d::BIGINT AS depth, count(*)::BIGINT AS n_files, sum(size)::BIGINT AS n_bytes
  FROM (SELECT unnest(p) AS path, unnest([NULL, p[1], p[2]]) AS parent, unnest([1, 2, 3]) AS d, size FROM ({_PARTS})) GROUP BY ALL""")
def path_tree(spark, sf_dir):
    files = file_bytes(spark, sf_dir).select("path", F.coalesce(F.octet_length("data"), F.lit(0)).alias("size"))
    nodes = files.select("size", F.posexplode(chunking.path_objects(F.col("path"))).alias("d", "path"))
    nodes = nodes.withColumn("parent", F.when(F.col("d") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    return nodes.groupBy("path", "parent", F.when(F.col("d") == 2, "File").otherwise("Directory").alias("type"), (F.col("d") + 1).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("n_bytes"))


@query("compressibility", """SELECT name, NOT (starts_with(h, '89504E470D0A1A0A') OR starts_with(h, 'FFD8FF') OR starts_with(h, '504B0304')) AS compress FROM (
  SELECT * FROM (VALUES ('png', '89504E470D0A1A0A00'), ('jpeg', 'FFD8FFE0'), ('zip', '504B030414'), ('text', '68656C6C6F'), ('short', '89')) t(name, h) UNION ALL SELECT page_id::VARCHAR, hex(encode(html)) FROM pages)""")
def compressibility(spark, sf_dir):
    literal = spark.createDataFrame([("png", "89504E470D0A1A0A00"), ("jpeg", "FFD8FFE0"), ("zip", "504B030414"), ("text", "68656C6C6F"), ("short", "89")], "name string, h string").select("name", F.unhex("h").alias("data"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").cast("binary").alias("data"))
    return literal.unionByName(pages).select("name", compressible(F.col("data")).alias("compress"))


@query("zstd_frame_roundtrip")
def zstd_frame_roundtrip(spark, sf_dir):
    files = file_bytes(spark, sf_dir).select("doc_id", "data")
    framed = encode_frames(files, "data", "frame")
    back = decode_frames(framed, "frame", "back", "status")
    return back.select("doc_id", F.octet_length("frame").cast("long").alias("stored"), F.octet_length("data").cast("long").alias("size"), "status", F.col("back").eqNullSafe(F.col("data")).alias("equal"))
