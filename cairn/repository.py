"""A repository of snapshots: content-addressed blobs, and manifests as Parquet tables.

    config.json           wrapped keys
    policy.json           retention policy
    history.jsonl         signed log
    data/ab/abcd...       sealed chunks, by digest
    manifests/<id>/       one row per chunk (and per file without chunks)
    staging/<id>/         tables of a backup that is under way
    snapshots/<id>.json   written last: a snapshot without it doesn't exist, and its chunks are garbage

The folder lies on a file system that the driver and all tasks mount.
"""

from __future__ import annotations

import json
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crypto
from .functions.codec import decode_frames, encode_frames
from .functions.hashing import digest, shard_key
from .operators import dedup, integrity, retention
from .sources import blobs, logs

CHUNK = 1 << 20
EPOCH = 1
MANIFEST = "path string, mtime long, size long, mode long, uid long, gid long, ord long, hash string, chunk_len long"
FILE = ["path", "mtime", "size", "mode", "uid", "gid"]
POLICY = {"enabled": False, "mode": "governance", "days": 0, "keep_last": 5, "keep_days": 30}


class Repository:
    def __init__(self, spark: SparkSession, folder: str, keys: crypto.Keys, actor: str = "local"):
        self.spark, self.root, self.keys, self.actor = spark, blobs.local_path(folder).rstrip("/"), keys, actor

    # --- opening ---

    @classmethod
    def create(cls, spark: SparkSession, folder: str, password: str) -> Repository:
        root = blobs.local_path(folder)
        if os.path.exists(f"{root}/config.json"):
            raise FileExistsError(f"{root} is a repository already")
        keys = crypto.Keys.new(spark)
        for d in ("data", "manifests", "snapshots"):
            os.makedirs(f"{root}/{d}", exist_ok=True)
        blobs.put_file(f"{root}/policy.json", json.dumps(POLICY).encode())
        blobs.put_file(f"{root}/config.json", json.dumps(keys.wrapped(password)).encode())
        return cls(spark, folder, keys)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, password: str) -> Repository:
        with open(f"{blobs.local_path(folder)}/config.json", encoding="utf-8") as f:
            return cls(spark, folder, crypto.Keys.unwrapped(spark, json.load(f), password))

    def change_password(self, password: str) -> None:
        """The same keys under another password; no blob changes."""
        blobs.put_file(f"{self.root}/config.json", json.dumps(self.keys.wrapped(password)).encode())

    # --- policy and log ---

    def policy(self) -> dict:
        with open(f"{self.root}/policy.json", encoding="utf-8") as f:
            return POLICY | json.load(f)

    def set_policy(self, **changes) -> dict:
        if unknown := set(changes) - set(POLICY):
            raise ValueError(f"no such field: {sorted(unknown)}")
        new = self.policy() | {k: v for k, v in changes.items() if v is not None}
        blobs.put_file(f"{self.root}/policy.json", json.dumps(new).encode())
        return new

    def _log(self, now: int, operation: str, **details) -> None:
        logs.append_history(self.spark, f"{self.root}/history.jsonl", self.keys.metadata, now, operation, self.actor, details)

    def history(self) -> DataFrame:
        """Log lines, each with whether it is broken or tampered."""
        entries = logs.read_history(self.spark, f"file://{self.root}/history.jsonl").withColumn("log", F.lit(0))
        text = logs.message(*[F.col(c) for c in ("version", "timestamp", "operation", "actor", "details")])
        return integrity.verified_chain(entries, ["log"], text, self.keys.metadata).drop("log")

    # --- tables ---

    def snapshots(self) -> DataFrame:
        """snapshot_id, timestamp, source, files, bytes; newest first."""
        rows = []
        for name in os.listdir(f"{self.root}/snapshots"):
            if name.endswith(".json"):
                with open(f"{self.root}/snapshots/{name}", encoding="utf-8") as f:
                    x = json.load(f)
                rows.append((name[:-5], x["timestamp"], x["source"], x["files"], x["bytes"]))
        found = self.spark.createDataFrame(rows, "snapshot_id string, timestamp long, source string, files long, bytes long")
        return found.orderBy(F.desc("timestamp"), "snapshot_id")

    def manifest(self, *snapshot_ids: str) -> DataFrame:
        if not snapshot_ids:
            return self.spark.createDataFrame([], MANIFEST + ", snapshot_id string")
        found = self.spark.read.schema(MANIFEST).parquet(*[f"file://{self.root}/manifests/{i}" for i in snapshot_ids])
        folder = F.url_decode(F.regexp_extract("_metadata.file_path", r"/manifests/([^/]+)/[^/]*$", 1))
        return found.withColumn("snapshot_id", folder)

    def _ids(self) -> list[str]:
        return [r.snapshot_id for r in self.snapshots().collect()]

    def refs(self) -> DataFrame:
        return self.manifest(*self._ids()).filter("hash is not null").select(F.col("hash").alias("chunk_hash"), "snapshot_id").distinct()

    def stored(self) -> DataFrame:
        """hash and stored size of each blob."""
        if not any(files for _, _, files in os.walk(f"{self.root}/data")):
            return self.spark.createDataFrame([], "hash string, stored_size long")
        return blobs.files(self.spark, f"file://{self.root}/data", content=False).select(F.substring_index("key", "/", -1).alias("hash"), F.col("size").alias("stored_size"))

    # --- single records ---

    def put_record(self, record: dict, kind: bytes = b"FPRT", version: int = 1, secret: bool = False) -> str:
        """Stores a record (a machine's fingerprint, say) as one chunk, with a mark and version before its JSON; its digest. Secret ones
        are sealed by the metadata key."""
        data = kind + version.to_bytes(4, "little") + json.dumps(record, sort_keys=True).encode()
        key = self.keys.metadata if secret else self.keys.data
        one = self.spark.range(1).select(F.lit(data).alias("d")).withColumn("hash", digest(F.col("d")))
        row = one.select("hash", crypto.seal_chunk(F.col("d"), F.col("hash"), key, EPOCH).alias("sealed")).first()
        blobs.put_file(f"{self.root}/data/{row.hash[:2]}/{row.hash}", bytes(row.sealed))
        return row.hash

    def get_record(self, name: str, kind: bytes = b"FPRT", version: int = 1, secret: bool = False) -> dict:
        """The record, or ValueError if it was altered, or has another mark or version."""
        with open(f"{self.root}/data/{name[:2]}/{name}", "rb") as f:
            sealed = f.read()
        key = self.keys.metadata if secret else self.keys.data
        plain = crypto.open_chunk(F.lit(sealed), F.lit(name), {EPOCH: key})
        row = self.spark.range(1).select(plain.alias("d")).select((digest(F.col("d")) == name).alias("sound"), crypto.header(F.col("d"), kind, version).alias("json")).first()
        if not row.sound or row.json is None:
            raise ValueError(f"{name} is not such a record")
        return json.loads(bytes(row.json))

    def describe(self, snapshot_id: str, **details) -> None:
        """Seals details (tags, description, host, ...) of a snapshot beside it."""
        logs.SecretStore(self.spark, f"{self.root}/metadata.json", self.keys.metadata).put(snapshot_id, json.dumps(details, sort_keys=True).encode())

    def summaries(self) -> DataFrame:
        """Snapshots with their details (JSON); null where there are none or they can't be opened."""
        rows = list(logs.load_store(f"{self.root}/metadata.json").items())
        sealed = self.spark.createDataFrame(rows, "snapshot_id string, sealed string")
        details = sealed.select("snapshot_id", crypto.open_text(F.unhex("sealed"), self.keys.metadata).alias("details"))
        return self.snapshots().join(details, "snapshot_id", "left").orderBy(F.desc("timestamp"), "snapshot_id")

    # --- backup, restore, verify, prune ---

    def backup(self, source: str, snapshot_id: str, now: int) -> dict:
        """Takes the regular files below ``source`` (a folder that all tasks mount). Files that the newest snapshot of that source has with the same time and size
        aren't read; chunks that are stored already aren't written."""
        if not re.fullmatch(r"[A-Za-z0-9_.:-]+", snapshot_id):
            raise ValueError("a snapshot's name has letters, digits and _.:- only")
        if os.path.exists(f"{self.root}/snapshots/{snapshot_id}.json"):
            raise FileExistsError(snapshot_id)
        staging = f"{self.root}/staging/{snapshot_id}"
        try:
            return self._staged_backup(source, snapshot_id, now, f"file://{staging}")
        finally:
            shutil.rmtree(staging, ignore_errors=True)

    def _staged_backup(self, source: str, snapshot_id: str, now: int, staging: str) -> dict:
        """The folder is walked once and each file read once, into tables of this backup (chunks sealed already). Blobs and manifest both
        come from these, so a file that changes meanwhile can't leave a manifest with chunks that were never stored."""

        def staged(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{staging}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{staging}/{name}")

        found = staged(blobs.walk(self.spark, source), "files")
        before = self.snapshots().filter(F.col("source") == source).limit(1).collect()
        old = self.manifest(*[r.snapshot_id for r in before]).drop("snapshot_id")
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        reused = found.join(old.select("path", "mtime", "size", "ord", "hash", "chunk_len"), ["path", "mtime", "size"]).select(*columns)
        read = staged(dedup.changed(found, old.select("path", "mtime", "size").distinct()), "read")
        chunks = blobs.read_chunks(read, source, CHUNK).withColumns({"hash": digest(F.col("chunk")), "chunk_len": F.octet_length("chunk").cast("long")})
        sealed = crypto.seal_chunk(F.col("frame"), F.col("hash"), self.keys.data, EPOCH)
        chunks = staged(encode_frames(chunks, "chunk", "frame").select("path", "ord", "hash", "chunk_len", sealed.alias("sealed")), "chunks")
        manifest = read.join(chunks.select("path", "ord", "hash", "chunk_len"), "path", "left").select(*columns)

        new = chunks.select("hash", "sealed").join(self.stored().select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first("sealed").alias("data"))
        blobs.put_blobs(new.select(shard_key(F.col("hash")).alias("key"), "data"), f"{self.root}/data")
        reused.unionByName(manifest).write.mode("overwrite").parquet(f"file://{self.root}/manifests/{snapshot_id}")

        total = found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        report = {"timestamp": now, "source": source, "files": total.files, "bytes": total.bytes}
        blobs.put_file(f"{self.root}/snapshots/{snapshot_id}.json", json.dumps(report).encode())
        self._log(now, "backup", snapshot=snapshot_id, files=total.files)
        return report | {"read": read.count()}

    def chunks(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (hash, ...) with data: unsealed, unpacked and checked; null where anything is wrong."""
        sealed = blobs.read_blobs(wanted.withColumn("key", shard_key(F.col("hash"))), f"{self.root}/data").withColumnRenamed("data", "sealed").drop("key")
        opened = sealed.withColumn("frame", crypto.open_chunk(F.col("sealed"), F.col("hash"), {EPOCH: self.keys.data})).drop("sealed")
        plain = decode_frames(opened, "frame", "data", "status").drop("frame", "status")
        return plain.withColumn("data", F.when(digest(F.col("data")) == F.col("hash"), F.col("data")))

    def restore(self, snapshot_id: str, target: str, now: int) -> None:
        """Writes a snapshot's files below ``target``, with owner, mode and time as far as they can be applied. A chunk that is missing or
        altered fails it. Only the blobs of this snapshot are opened."""
        rows = self.manifest(snapshot_id).select("path", "ord", "hash")
        once = self.chunks(rows.filter("hash is not null").select("hash").distinct())
        sound = F.when(F.col("hash").isNull() | F.col("data").isNotNull(), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("missing or altered: "), F.col("hash"))).cast("binary"))
        blobs.write_files(rows.join(once, "hash", "left").withColumn("chunk", sound), target)
        warnings = blobs.apply_metadata(self.manifest(snapshot_id).select(*FILE).distinct(), target).count()
        self._log(now, "restore", snapshot=snapshot_id, warnings=warnings)

    def verify(self) -> DataFrame:
        """hash and status (ok, missing, damaged) of each referenced chunk."""
        wanted = self.refs().select(F.col("chunk_hash").alias("hash")).distinct()
        there = self.stored().select("hash", F.lit(True).alias("there"))
        return self.chunks(wanted).join(there, "hash", "left").select("hash", F.when(F.col("there").isNull(), "missing").when(F.col("data").isNull(), "damaged").otherwise("ok").alias("status"))

    def prune(self, keep_last: int, keep_days: int, now: int, dry_run: bool = False) -> dict:
        """Drops the snapshots that neither rule keeps, and all blobs that no kept one names."""
        marked = retention.with_keep(self.snapshots(), keep_last, keep_days, now).select("snapshot_id", "keep").collect()
        kept, dropped = [r.snapshot_id for r in marked if r.keep], [r.snapshot_id for r in marked if not r.keep]
        live = self.manifest(*kept).filter("hash is not null").select(F.col("hash").alias("chunk_hash")).distinct()
        garbage = dedup.orphans(self.stored(), live)
        total = garbage.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("bytes")).first()
        report = {"kept": len(kept), "dropped": len(dropped), "chunks": total.n, "bytes": total.bytes}
        if dry_run:
            return report
        # Markers go first: from then on what is left behind is garbage that the next run finds.
        for i in dropped:
            os.remove(f"{self.root}/snapshots/{i}.json")
        blobs.delete_blobs(garbage.select(shard_key(F.col("hash")).alias("key")), f"{self.root}/data")
        for i in os.listdir(f"{self.root}/manifests"):
            if i not in kept:
                shutil.rmtree(f"{self.root}/manifests/{i}", ignore_errors=True)
        self._log(now, "prune", **report)
        return report
