"""References and change tracking. A reference is a distinct (l_partkey, l_orderkey mod 50) of lineitem; chunks are parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, dedup
from .registry import query, table

REFS = "SELECT DISTINCT l_partkey AS chunk_hash, l_orderkey % 50 AS snapshot_id FROM lineitem"


def all_refs(spark, sf_dir, where="true"):
    """References, some of them more than once; whoever asks only whether there is one needs no more."""
    return table(spark, sf_dir, "lineitem").filter(where).select(F.col("l_partkey").alias("chunk_hash"), (F.col("l_orderkey") % 50).alias("snapshot_id"))


def refs(spark, sf_dir, where="true"):
    return all_refs(spark, sf_dir, where).distinct()


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), F.col("p_size").cast("long").alias("stored_size"), (F.col("p_size") * 2).cast("long").alias("uncompressed_size"))


@query("dedup_stats", f"SELECT count(DISTINCT chunk_hash)::BIGINT AS unique_chunks, count(*)::BIGINT AS total_references, count(DISTINCT snapshot_id)::BIGINT AS snapshots FROM ({REFS})")
def dedup_stats(spark, sf_dir):
    return dedup.stats(refs(spark, sf_dir))


@query("chunk_refcount", f"SELECT chunk_hash, count(*)::BIGINT AS refcount FROM ({REFS}) GROUP BY 1")
def chunk_refcount(spark, sf_dir):
    return dedup.refcounts(refs(spark, sf_dir))


@query("orphan_chunks", "SELECT p_partkey AS hash, p_size::BIGINT AS stored_size FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def orphan_chunks(spark, sf_dir):
    """Fixture: only lines of more than 48 pieces refer to a chunk, else every part would have a reference."""
    return dedup.orphans(chunks(spark, sf_dir), all_refs(spark, sf_dir, "l_quantity > 48")).select("hash", "stored_size")


@query("newly_unreferenced", f"SELECT chunk_hash, count(*)::BIGINT AS n FROM ({REFS}) GROUP BY 1 HAVING count(*) = count_if(snapshot_id < 47)")
def newly_unreferenced(spark, sf_dir):
    """Over all references: the last three of the 50 snapshots stay, so that chunks of the others come out."""
    return dedup.newly_unreferenced(refs(spark, sf_dir), F.col("snapshot_id") < 47)


@query("drop_snapshot", f"SELECT chunk_hash, count(*)::BIGINT AS refcount FROM ({REFS}) WHERE snapshot_id NOT IN (3, 4, 5) GROUP BY 1")
def drop_snapshot(spark, sf_dir):
    return dedup.refcounts(dedup.drop_snapshots(refs(spark, sf_dir), [3, 4, 5]))


@query("add_references", f"""SELECT snapshot_id, count(*)::BIGINT AS n FROM (SELECT * FROM ({REFS}) UNION SELECT p_partkey, 50 FROM part UNION SELECT p_partkey, 3 FROM part WHERE p_size > 25) GROUP BY 1""")
def add_references(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    new = parts.select(F.col("p_partkey").alias("chunk_hash"), F.lit(50).cast("long").alias("snapshot_id"))
    some = parts.filter("p_size > 25").select(F.col("p_partkey").alias("chunk_hash"), F.lit(3).cast("long").alias("snapshot_id"))
    out = dedup.add_references(refs(spark, sf_dir), new.unionByName(new).unionByName(some))
    return out.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_exists", "SELECT o_orderkey AS hash, EXISTS (SELECT 1 FROM part WHERE p_partkey = o_orderkey) AS \"exists\" FROM orders")
def chunk_exists(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"))
    return dedup.with_existence(wanted, chunks(spark, sf_dir))


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size"), "doc_id")


def _tracked(spark, sf_dir):
    """The tracker before: every seventh file was one second older, every eleventh wasn't there."""
    before = _files(spark, sf_dir).filter("doc_id % 11 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 7 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return before.withColumn("chunks", F.transform(F.sequence(F.lit(0), F.expr("cast(size div 4096 as int)")), lambda i: F.concat_ws(":", "path", i.cast("string")))).drop("doc_id")


_PATH = "concat_ws('/', source, lang, doc_id::VARCHAR)"


@query("unchanged_files", f"SELECT {_PATH} AS path, n_chars AS size, (n_chars // 4096 + 1)::BIGINT AS n_chunks, {_PATH} || ':0' AS first_chunk FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def unchanged_files(spark, sf_dir):
    out = dedup.unchanged(_files(spark, sf_dir), _tracked(spark, sf_dir))
    return out.select("path", "size", F.size("chunks").cast("long").alias("n_chunks"), F.get("chunks", F.lit(0)).alias("first_chunk"))


@query("changed_files", f"SELECT {_PATH} AS path, n_chars AS size FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def changed_files(spark, sf_dir):
    return dedup.changed(_files(spark, sf_dir), _tracked(spark, sf_dir)).select("path", "size")


@query("record_files", f"SELECT {_PATH} AS path, CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE doc_id - (doc_id % 7 = 0)::INT END::BIGINT AS mtime FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 5 = 0")
def record_files(spark, sf_dir):
    rows = _files(spark, sf_dir).filter("doc_id % 5 = 0").drop("doc_id").withColumn("chunks", F.array().cast("array<string>"))
    return dedup.record(_tracked(spark, sf_dir), rows).select("path", "mtime")


@query("catalog_upsert", """SELECT p_partkey AS hash, CASE WHEN p_partkey % 10 = 0 THEN 7 ELSE p_size END::BIGINT AS stored_size FROM part
  UNION ALL SELECT -1 - s_suppkey, 1::BIGINT FROM supplier""")
def catalog_upsert(spark, sf_dir):
    """Chunks after inserts of known and of new hashes (twice each) and replacements."""
    base = chunks(spark, sf_dir).select("hash", "stored_size")
    new = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("hash"), F.lit(1).cast("long").alias("stored_size"))
    grown = catalog.insert_absent(base, new.unionByName(new).unionByName(base.withColumn("stored_size", F.lit(-1).cast("long"))), ["hash"])
    return catalog.upsert(grown, base.filter("hash % 10 = 0").withColumn("stored_size", F.lit(7).cast("long")), ["hash"])


@query("catalog_delete", "SELECT p_partkey AS hash FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def catalog_delete(spark, sf_dir):
    """Fixture: the chunks of lines of more than 49 pieces go, else none would stay."""
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("hash"))
    return catalog.delete(chunks(spark, sf_dir), gone, ["hash"]).select("hash")


@query("catalog_stats", "SELECT (SELECT count(DISTINCT l_orderkey % 50) FROM lineitem)::BIGINT AS snapshots, (SELECT count(*) FROM orders)::BIGINT AS objects, (SELECT count(*) FROM part)::BIGINT AS chunks")
def catalog_stats(spark, sf_dir):
    return catalog.stats(refs(spark, sf_dir).select("snapshot_id").distinct(), table(spark, sf_dir, "orders"), chunks(spark, sf_dir))


@query("catalog_key_violations", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def catalog_key_violations(spark, sf_dir):
    return catalog.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ordered_turns", "SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def ordered_turns(spark, sf_dir):
    """Ordered chunk lists: the turns of each conversation."""
    turns = table(spark, sf_dir, "conversations")
    out = catalog.ordered_list(turns, ["conv_id"], "turn", "role")
    return out.select("conv_id", F.array_join("role", ">").alias("roles"), F.size("role").cast("long").alias("n"))


@query("object_types", "SELECT l_linenumber AS code, CASE l_linenumber WHEN 1 THEN 'Directory' WHEN 2 THEN 'BlockDevice' WHEN 3 THEN 'SystemFingerprint' ELSE 'File' END AS type, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def object_types(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("code"))
    return rows.groupBy("code", catalog.object_type(F.col("code")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
