"""Workloads over real folders: backup, restore, verify and prune, blobs, locks, sealed stores, devices. Each writes below the shared
folder; nations become files r<region>/<nation>.txt whose text repeats the region's name, so that files share chunks."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ..functions import crypto, parsers
from ..functions.hashing import digest, shard_key
from ..operators import catalog
from ..repository import Repository
from ..shared import scratch_dir
from ..sources import blobs, locks, logs
from .registry import query, table

_TIMES, _MIB = 150_000, 1 << 20
_FILES = f"SELECT n_regionkey, 'r' || n_regionkey || '/' || n_name || '.txt' AS path, repeat(r_name || ' ', {_TIMES}) AS t FROM nation JOIN region ON n_regionkey = r_regionkey"
_CHUNKS = f"SELECT n_regionkey, path, ord, sha256(substr(t, ord * {_MIB} + 1, {_MIB})) AS hash FROM (SELECT *, unnest(range(0, (length(t) + {_MIB - 1}) // {_MIB})) AS ord FROM ({_FILES}))"


def _folder(spark) -> str:
    """A new folder for files, on a file system that driver and tasks mount."""
    path = scratch_dir(spark, "files")
    if not blobs.mounted(path):
        raise ValueError(f"{path} is not mounted")
    return blobs.local_path(path)


def _nations(spark, sf_dir):
    text = F.repeat(F.concat("r_name", F.lit(" ")), F.lit(_TIMES)).cast("binary")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.format_string("r%d/%s.txt", "n_regionkey", "n_name").alias("path"), F.lit(0).alias("ord"), text.alias("chunk"), "n_regionkey")


def _backed_up(spark, sf_dir) -> tuple[Repository, str]:
    root = _folder(spark)
    blobs.write_files(_nations(spark, sf_dir), f"{root}/source")
    repo = Repository.create(spark, f"{root}/repo", "a password")
    repo.backup(f"{root}/source", "first", 1000)
    return repo, root


@query("repo_backup_restore", f"SELECT path, length(t)::BIGINT AS size, sha256(t) AS hash, true AS same_metadata FROM ({_FILES})")
def repo_backup_restore(spark, sf_dir):
    """Restored bytes, by an opened repository, and whether mode, owner and time are those of the source."""
    _, root = _backed_up(spark, sf_dir)
    Repository.open(spark, f"{root}/repo", "a password").restore("first", f"{root}/out", 2000)
    names = ["path", "size", "mtime", "mode", "uid", "gid"]
    same = blobs.walk(spark, f"{root}/source").select(*names, F.lit(True).alias("same")).join(blobs.walk(spark, f"{root}/out"), names, "right").select("path", "same")
    read = blobs.files(spark, f"file://{root}/out").select(F.col("key").alias("path"), "size", digest(F.col("data")).alias("hash"))
    return read.join(same, "path").select("path", "size", "hash", F.coalesce("same", F.lit(False)).alias("same_metadata"))


@query("repo_increments", f"""WITH c AS ({_CHUNKS}), a AS (SELECT count(DISTINCT path) AS files, count(DISTINCT hash) AS chunks FROM c)
  SELECT 'first' AS snapshot_id, files::BIGINT AS files, files::BIGINT AS files_read, chunks::BIGINT AS stored, chunks::BIGINT AS refs FROM a
  UNION ALL SELECT 'second', files + 1, 1, chunks + 1, 2 * chunks + 1 FROM a""")
def repo_increments(spark, sf_dir):
    """A second backup reads the one new file only; chunks are stored once."""
    root = _folder(spark)
    blobs.write_files(_nations(spark, sf_dir), f"{root}/source")
    repo = Repository.create(spark, f"{root}/repo", "a password")
    rows = []
    for k, name in enumerate(("first", "second")):
        if k:
            blobs.put_file(f"{root}/source/new.txt", b"new")
        report = repo.backup(f"{root}/source", name, 1000 + k)
        rows.append((name, report["files"], report["read"], repo.stored().count(), repo.refs().count()))
    return spark.createDataFrame(rows, "snapshot_id string, files long, files_read long, stored long, refs long")


@query("repo_verify", f"""SELECT hash, CASE WHEN min(n_regionkey) = 0 THEN 'missing' WHEN min(n_regionkey) = 1 THEN 'damaged' ELSE 'ok' END AS status FROM ({_CHUNKS}) GROUP BY hash""")
def repo_verify(spark, sf_dir):
    """The blobs of region 0 are deleted, those of region 1 altered; each referenced chunk is fetched, opened and hashed again."""
    repo, root = _backed_up(spark, sf_dir)
    region = F.substring("path", 2, 1).cast("int")
    held = repo.manifest("first").select("hash", region.alias("r")).distinct().filter("r < 2").select(shard_key(F.col("hash")).alias("key"), "r")
    blobs.delete_blobs(held.filter("r = 0"), f"{root}/repo/data")
    altered = blobs.read_blobs(held.filter("r = 1").select("key"), f"{root}/repo/data")
    blobs.put_blobs(altered.withColumn("data", F.concat("data", F.lit(b"!"))), f"{root}/repo/data")
    return repo.verify()


@query("repo_prune", f"SELECT DISTINCT hash, 'second' AS snapshot_id FROM ({_CHUNKS}) WHERE n_regionkey > 0")
def repo_prune(spark, sf_dir):
    """The files of region 0 go, a second backup is taken, and all but the last snapshot are pruned: what is stored, and its snapshots."""
    repo, root = _backed_up(spark, sf_dir)
    for name in os.listdir(f"{root}/source/r0"):
        os.remove(f"{root}/source/r0/{name}")
    repo.backup(f"{root}/source", "second", 2000)
    repo.set_policy(keep_last=1, keep_days=0)
    policy = repo.policy()
    repo.prune(policy["keep_last"], policy["keep_days"], 3000)
    return repo.stored().select("hash").join(repo.refs().withColumnRenamed("chunk_hash", "hash"), "hash", "left")


@query("repo_history", """SELECT i::BIGINT AS idx, CASE WHEN i % 2 = 1 THEN 'restore' ELSE 'backup' END AS operation, i = 2 AS tampered FROM range(0, (SELECT count(*) FROM region)) r(i)""")
def repo_history(spark, sf_dir):
    """A log of as many entries as there are regions, the third of which is altered afterwards."""
    path, key = f"{_folder(spark)}/history.jsonl", b"k" * 32
    os.makedirs(os.path.dirname(path))
    for k in range(table(spark, sf_dir, "region").count()):
        logs.append_history(spark, path, key, 1000 + k, "restore" if k % 2 else "backup", "someone", {"k": k})
    with open(path, encoding="utf-8") as f:
        lines = [json.loads(x) for x in f if x.strip()]
    lines[2]["actor"] = "someone else"
    blobs.put_file(path, "\n".join(json.dumps(x) for x in lines).encode() + b"\n")
    from ..operators import integrity

    entries = logs.read_history(spark, f"file://{path}").withColumn("log", F.lit(0))
    text = logs.message(*[F.col(c) for c in ("version", "timestamp", "operation", "actor", "details")])
    return integrity.verified_chain(entries, ["log"], text, key).select(F.col("idx").cast("long").alias("idx"), "operation", "tampered")


@query("repo_summaries", "SELECT r_name AS snapshot_id, r_regionkey::BIGINT AS timestamp, r_regionkey AS tag FROM region WHERE r_regionkey <> 3 UNION ALL SELECT r_name, r_regionkey, NULL FROM region WHERE r_regionkey = 3")
def repo_summaries(spark, sf_dir):
    """A snapshot for each region, with sealed details for all but one."""
    root = _folder(spark)
    repo = Repository.create(spark, f"{root}/repo", "a password")
    blobs.put_file(f"{root}/source/x", b"x")
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        repo.backup(f"{root}/source", r.r_name.replace(" ", "_"), r.r_regionkey)
        if r.r_regionkey != 3:
            repo.describe(r.r_name.replace(" ", "_"), tag=r.r_regionkey)
    name, tag = F.replace(F.col("snapshot_id"), F.lit("_"), F.lit(" ")), F.get_json_object("details", "$.tag")
    return repo.summaries().select(name.alias("snapshot_id"), "timestamp", tag.cast("int").alias("tag"))


@query("repo_records", "SELECT r_regionkey, r_name AS name, true AS altered_is_refused FROM region")
def repo_records(spark, sf_dir):
    """Records of a mark and version, sealed by either key; one of another mark is refused."""
    repo = Repository.create(spark, f"{_folder(spark)}/repo", "a password")
    repo.change_password("another")
    rows = []
    for r in table(spark, sf_dir, "region").collect():
        secret = r.r_regionkey % 2 == 1
        at = repo.put_record({"name": r.r_name}, kind=b"FPRT", secret=secret)
        try:
            repo.get_record(at, kind=b"SHDW", secret=secret)
            refused = False
        except ValueError:
            refused = True
        rows.append((r.r_regionkey, repo.get_record(at, kind=b"FPRT", secret=secret)["name"], refused))
    return spark.createDataFrame(rows, "r_regionkey int, name string, altered_is_refused boolean")


@query("sealed_store", "SELECT r_name AS name, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE 'secret of ' || r_name END AS secret FROM region WHERE r_regionkey <> 2")
def sealed_store(spark, sf_dir):
    """A store of sealed values by name: put, put again, delete, list, get."""
    store = logs.SecretStore(spark, f"{_folder(spark)}/vault.json", b"k" * 32)
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        store.put(r.r_name, f"secret of {r.r_name}".encode())
        if r.r_regionkey == 1:
            store.put(r.r_name, b"changed")
        if r.r_regionkey == 2:
            store.delete(r.r_name)
    return spark.createDataFrame([(n, store.get(n).decode()) for n in store.names()], "name string, secret string")


_SUPPLIERS = "SELECT s_suppkey, sha256(s_name) AS hash, s_name, substr(sha256(s_name), 1, 2) || '/' || sha256(s_name) AS key FROM supplier"


@query("blob_store", f"SELECT key, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS text, s_suppkey % 5 > 0 AS listed FROM ({_SUPPLIERS})")
def blob_store(spark, sf_dir):
    """A blob for each supplier, checked by its hash as it is written; a fifth is deleted; all are asked for, and the folder is listed."""
    root = _folder(spark)
    name = F.col("s_name").cast("binary")
    rows = table(spark, sf_dir, "supplier").select(shard_key(digest(name)).alias("key"), name.alias("data"), "s_suppkey")
    blobs.put_blobs(rows, root, check_hash=True)
    blobs.delete_blobs(rows.filter("s_suppkey % 5 = 0"), root)
    listed = blobs.files(spark, f"file://{root}", content=False).select("key", F.lit(True).alias("listed"))
    found = blobs.get_blobs(spark, root, rows.select("key")).select("key", F.col("data").cast("string").alias("text"))
    return found.join(listed, "key", "left").select("key", "text", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("file_tree", "SELECT r_name || '/' || n_name AS path, length(repeat(n_name, n_nationkey))::BIGINT AS size, length(repeat(n_name, n_nationkey)) > 60 AS too_large, false AS top FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '.' || r_name, 0, false, true FROM region")
def file_tree(spark, sf_dir):
    """A tree of files, hidden and empty ones too, with those over a size told apart."""
    root = _folder(spark)
    regions = table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.repeat("n_name", F.col("n_nationkey")).cast("binary").alias("chunk"))
    rows = rows.unionByName(regions.select(F.concat(F.lit("."), F.col("r_name")).alias("path"), F.lit(None).cast("binary").alias("chunk")))
    blobs.write_files(rows.withColumn("ord", F.lit(0)), root)
    small, large = blobs.small_files(spark, f"file://{root}", 60)
    kinds = small.select(F.col("key").alias("path"), F.lit(False).alias("l")).unionByName(large.select(F.col("key").alias("path"), F.lit(True).alias("l")))
    return blobs.walk(spark, root).join(kinds, "path", "left").select("path", "size", F.coalesce("l", F.lit(False)).alias("too_large"), (~F.contains("path", F.lit("/"))).alias("top"))


@query("sparse_device", "SELECT r_regionkey, sha256(repeat(r_name, 1000)) AS hash, true AS sparse FROM region")
def sparse_device(spark, sf_dir):
    """A sparse image with a piece for each region, a MiB apart, copied by its allocated ranges alone; the pieces of the copy."""
    root = _folder(spark)
    os.makedirs(root)
    data = F.repeat("r_name", F.lit(1000)).cast("binary")
    pieces = table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") * _MIB).cast("long").alias("at"), data.alias("data"))
    size = 16 * _MIB
    blobs.write_device(pieces, f"{root}/image", size)
    ranges = blobs.extents(spark.createDataFrame([(f"{root}/image",)], "device string"), _MIB // 4)
    copied = blobs.read_ranges(ranges.select("device", F.col("extent_offset").alias("at"), F.col("extent_len").alias("len")))
    blobs.write_device(copied, f"{root}/copy", size)
    wanted = pieces.select(F.lit(f"{root}/copy").alias("device"), "at", F.octet_length("data").cast("long").alias("len"))
    few = ranges.agg(F.sum("extent_len").alias("n")).select((F.col("n") < size).alias("sparse"))
    return blobs.read_ranges(wanted).select((F.col("at") / _MIB).cast("int").alias("r_regionkey"), digest(F.col("data")).alias("hash")).crossJoin(F.broadcast(few))


@query("locked_blobs", "SELECT n_name AS key, n_nationkey % 3 = 0 AS stays FROM nation")
def locked_blobs(spark, sf_dir):
    """A third of the blobs is locked until 100; all are deleted at 50; what is still there."""
    root = _folder(spark)
    store = locks.LockedStore(spark, root)
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_name").cast("binary").alias("data"), "n_nationkey")
    store.write_once(rows.filter("n_nationkey % 3 = 0").select("key", "data"), {"mode": "compliance", "retain_until": 100})
    store.write_once(rows.filter("n_nationkey % 3 <> 0").select("key", "data"), None)
    store.delete(rows.select("key"), 50).count()
    return blobs.read_blobs(rows.select("key"), root).select("key", F.col("data").isNotNull().alias("stays"))


@query("canaries", "SELECT r_name AS folder, r_regionkey % 2 = 1 AS altered FROM region")
def canaries(spark, sf_dir):
    """A canary in a folder for each region; every other one is altered."""
    root = _folder(spark)
    for r in table(spark, sf_dir, "region").collect():
        path = locks.deploy_canary(f"{root}/{r.r_name}")
        if r.r_regionkey % 2:
            blobs.put_file(path, b"something else")
    held = blobs.files(spark, f"file://{root}")
    bad = locks.altered_canaries(held).select("key", F.lit(True).alias("bad"))
    return held.join(bad, "key", "left").select(F.substring_index("key", "/", 1).alias("folder"), F.coalesce("bad", F.lit(False)).alias("altered"))


@query("surrogate_ids", "SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS id FROM customer")
def surrogate_ids(spark, sf_dir):
    """Ids after the table's largest one, in a given order."""
    there = spark.range(1).select(F.lit(1000).cast("long").alias("id"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("down"))
    return catalog.with_ids(there, rows, "id", ["down", "c_custkey"]).select("c_custkey", "id")


@query("sealed_texts", "SELECT s_suppkey, s_name AS text, true AS wrong_key_refused FROM supplier")
def sealed_texts(spark, sf_dir):
    """Texts sealed with a nonce of their own, opened with the right key and a wrong one."""
    keys = crypto.Keys.new(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", crypto.seal_text(F.col("s_name"), keys.data).alias("frame"))
    at = scratch_dir(spark, "sealed")
    rows.write.parquet(at)  # nonces are random: sealed once
    sealed = spark.read.schema(rows.schema).parquet(at)
    refused = crypto.open_text(F.col("frame"), keys.metadata).isNull()
    return sealed.select("s_suppkey", crypto.open_text(F.col("frame"), keys.data).alias("text"), refused.alias("wrong_key_refused"))


@query("root_disks", r"""SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN '/dev/sd' || chr(97 + c_nationkey % 26) WHEN 1 THEN '/dev/nvme' || c_nationkey || 'n1' WHEN 2 THEN '/dev/vdb' END AS disk FROM customer""")
def root_disks(spark, sf_dir):
    """Kernel command lines with the root device named, named by its UUID, or not at all."""
    n = F.col("c_nationkey")
    letter = F.char(F.lit(97) + n % 26)
    line = F.when(n % 4 == 0, F.concat(F.lit("quiet root=/dev/sd"), letter, F.lit("2 ro"))).when(n % 4 == 1, F.format_string("root=/dev/nvme%dn1p%d", n, n + 1)).when(n % 4 == 2, F.lit("ro root=UUID=ab-cd splash")).otherwise(F.lit("ro noroot=/dev/sda1"))
    known = F.create_map(F.lit("ab-cd"), F.lit("/dev/vdb3"))
    return table(spark, sf_dir, "customer").select("c_custkey", parsers.root_disk(line, known).alias("disk"))


@query("scalar_rules", r"""SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_.-]{1,128}') AS safe, coalesce(try_cast(regexp_extract(c_name, '#(\d+)$', 1) AS BIGINT), 0) AS number, c_name AS unquoted FROM customer""")
def scalar_rules(spark, sf_dir):
    """Names of volumes, numbers and quoted texts, read from customers' names."""
    c = table(spark, sf_dir, "customer")
    number = parsers.number(F.regexp_extract("c_name", r"#(\d+)$", 1))
    return c.select("c_custkey", parsers.is_safe_lv_name(F.col("c_name")).alias("safe"), number.alias("number"), parsers.unquoted(F.concat(F.lit("\"'"), "c_name", F.lit("'"))).alias("unquoted"))
