"""Content-addressed blobs below a folder, files of a tree, and sparse devices, as sources and sinks.

Folders are listed by Spark's binaryFile reader, so any file system Spark knows will do (s3a:// for S3). Single blobs are read, written
and deleted in the tasks: on a file system that all of them mount, or in an object store (``Remote``).
"""

from __future__ import annotations

import errno
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest files that captures take along.
MIB, KEYRING = 1 << 20, 256 << 10
MAX_EXTENT = 1 << 30


def local_path(folder: str) -> str:
    return folder.removeprefix("file://")


def files(spark: SparkSession, folder: str, recursive: bool = True, content: bool = True, empty: bool = False) -> DataFrame:
    """key (relative to the folder), mtime (seconds), size and data of the regular files below a folder.

    Without ``content`` no file is opened. The reader skips files without bytes; with ``empty`` those of a mounted folder are added.
    An empty folder gives no rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    base = local_path(folder).rstrip("/")
    key = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in base) + "/+", "")
    columns = [key.alias("key"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size")]
    found = found.select(*columns, *([F.col("content").alias("data")] if content else []))
    if empty:
        none = walk(spark, folder).filter("size = 0").filter(~F.col("path").rlike("(^|/)[._]") & (F.lit(recursive) | ~F.contains("path", F.lit("/"))))
        found = found.unionByName(none.select(F.col("path").alias("key"), "mtime", "size", *([F.lit(b"").alias("data")] if content else [])))
    return found


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), mtime, size, mode, uid and gid of all regular files below a folder that the tasks mount: hidden ones and those
    without bytes too, which Spark's readers skip. Links are not followed; what can't be read is left out."""
    base = local_path(folder).rstrip("/")
    tops = sorted(os.listdir(base))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(top: str) -> Iterator[str]:
            if not os.path.isdir(top):
                yield top
            elif not os.path.islink(top):
                for d, _, names in os.walk(top):
                    yield from (os.path.join(d, n) for n in names)

        for batch in batches:
            rows = []
            for top in batch.column(0).to_pylist():
                for path in found(os.path.join(base, top)):
                    try:
                        st = os.lstat(path)
                    except OSError:
                        continue
                    if stat.S_ISREG(st.st_mode):
                        rows.append((os.path.relpath(path, base), int(st.st_mtime), st.st_size, stat.S_IMODE(st.st_mode), st.st_uid, st.st_gid))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))], names=["path", "mtime", "size", "mode", "uid", "gid"])

    top = spark.createDataFrame([(t,) for t in tops], "top string")
    return top.repartition(max(1, min(len(tops), 256))).mapInArrow(of, "path string, mtime long, size long, mode long, uid long, gid long")


def read_chunks(paths: DataFrame, folder: str, size: int) -> DataFrame:
    """path, ord, chunk: the files (path) in parts of ``size`` bytes, as they are read: no file is held whole."""
    base = local_path(folder).rstrip("/")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(os.path.join(base, path), "rb") as f:
                    for k, part in enumerate(iter(lambda: f.read(size), b"")):  # noqa: B023
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([part], pa.binary())], names=["path", "ord", "chunk"])

    return paths.select("path").repartition("path").mapInArrow(of, "path string, ord long, chunk binary")


def total_bytes(spark: SparkSession, folder: str) -> int:
    return files(spark, folder, content=False).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def first_files(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """The first ``most`` files in order of key."""
    return files(spark, folder).orderBy("key").limit(most)


def small_files(spark: SparkSession, folder: str, most_bytes: int = MIB) -> tuple[DataFrame, DataFrame]:
    """(files of at most ``most_bytes``, warnings: key and message of the others)."""
    all_ = files(spark, folder)
    return all_.filter(F.col("size") <= most_bytes), all_.filter(F.col("size") > most_bytes).select("key", F.format_string("%d bytes: too large", "size").alias("message"))


def mounted(folder: str) -> bool:
    """Whether tasks open the folder's files by themselves; others are read by Spark (s3a:// and the like)."""
    return "://" not in folder or folder.startswith("file://")


class Mounted:
    """Blobs below a folder that all tasks mount."""

    def __init__(self, folder: str):
        self.base = local_path(folder)

    def put(self, key: str, data: bytes) -> None:
        put_file(os.path.join(self.base, key), data)

    def get(self, key: str) -> bytes:
        with open(os.path.join(self.base, key), "rb") as f:
            return f.read()

    def delete(self, key: str) -> None:
        os.remove(os.path.join(self.base, key))


class Remote:
    """Blobs of an object store by the URI of their folder (s3://bucket/prefix, s3a:// alike), through pyarrow's file systems in the
    tasks. Such a store shows an object whole or not at all."""

    def __init__(self, folder: str):
        self.folder = re.sub("^s3[an]://", "s3://", folder.rstrip("/"))

    def _at(self, key: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.folder}/{key}")

    def put(self, key: str, data: bytes) -> None:
        system, path = self._at(key)
        if not path.startswith("s3") and system.type_name in ("local", "hdfs"):
            system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(data)

    def get(self, key: str) -> bytes:
        system, path = self._at(key)
        with system.open_input_stream(path) as f:
            return f.read()

    def delete(self, key: str) -> None:
        system, path = self._at(key)
        system.delete_file(path)


def store_of(folder: str) -> Mounted | Remote:
    return Mounted(folder) if mounted(folder) else Remote(folder)


def read_blobs(keys: DataFrame, folder: str | Mounted | Remote, most_bytes: int = 16 << 20) -> DataFrame:
    """``keys`` (key, ...) with data: each blob opened by its key in the tasks, so that nothing else is read; null for a key that isn't
    there. Rows go on when ``most_bytes`` are read."""
    store, at = store_of(folder) if isinstance(folder, str) else folder, keys.columns.index("key")
    schema = T.StructType([*keys.schema.fields, T.StructField("data", T.BinaryType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[bytes | None] = []
            first = size = 0

            def held(end: int) -> pa.RecordBatch:
                columns = [c.slice(first, end - first) for c in batch.columns]  # noqa: B023
                return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "data"])  # noqa: B023

            for k, key in enumerate(batch.column(at).to_pylist()):
                try:
                    data.append(store.get(key) if key is not None else None)
                except FileNotFoundError:
                    data.append(None)
                size += len(data[-1] or b"")
                if size > most_bytes:
                    yield held(k + 1)
                    data, first, size = [], k + 1, 0
            if data:
                yield held(batch.num_rows)

    return keys.mapInArrow(of, schema)


def get_blobs(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with data; null for a key that isn't there."""
    return read_blobs(keys, folder)


def put_file(path: str, data: bytes) -> None:
    """Whole or not at all: a temporary file is synced and renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.remove(temporary)
        raise


def put_blobs(blobs: DataFrame, folder: str | Mounted | Remote, check_hash: bool = False) -> None:
    """Writes data under key for each row (key, data). A task that runs again writes the same again.

    With ``check_hash`` a key that isn't ab/hash of its data fails the task.
    """
    store = store_of(folder) if isinstance(folder, str) else folder

    def write(rows) -> None:
        import hashlib

        for row in rows:
            if check_hash and row["key"].split("/")[-1] != hashlib.sha256(row["data"]).hexdigest():
                raise ValueError(f"{row['key']} does not name its bytes")
            store.put(row["key"], bytes(row["data"]))

    blobs.select("key", "data").foreachPartition(write)


def delete_blobs(keys: DataFrame, folder: str | Mounted | Remote) -> None:
    store = store_of(folder) if isinstance(folder, str) else folder

    def remove(rows) -> None:
        for row in rows:
            try:
                store.delete(row["key"])
            except FileNotFoundError:
                continue

    keys.select("key").foreachPartition(remove)


def write_files(chunks: DataFrame, folder: str) -> None:
    """Files again from (path, ord, chunk), each written in order as its chunks come by: no file is held whole.

    A path that leads out of the folder fails the task. A file of no chunks has one row with a null chunk.
    """
    base = os.path.realpath(local_path(folder))

    def write(rows) -> None:
        path, out = None, None
        try:
            for row in rows:
                if row["path"] != path:
                    if out:
                        out.close()
                    path = row["path"]
                    target = os.path.realpath(os.path.join(base, path))
                    if os.path.commonpath([base, target]) != base:
                        raise ValueError(f"{path} leads out of the folder")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    out = open(target, "wb")  # noqa: SIM115
                if row["chunk"] is not None:
                    out.write(bytes(row["chunk"]))
        finally:
            if out:
                out.close()

    chunks.select("path", "ord", "chunk").repartition("path").sortWithinPartitions("path", "ord").foreachPartition(write)


def apply_metadata(files: DataFrame, folder: str) -> DataFrame:
    """Gives the files (path, mtime, mode, uid, gid) below ``folder`` their owner, mode and time; path and message of what couldn't be
    applied (only root may give files away), which is a warning and no failure."""
    base = local_path(folder)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            warnings = []
            for row in batch.to_pylist():
                path = os.path.join(base, row["path"])
                steps = [lambda: os.chown(path, row["uid"], row["gid"]), lambda: os.chmod(path, row["mode"]), lambda: os.utime(path, (row["mtime"], row["mtime"]))]  # noqa: B023
                for step in steps:
                    try:
                        step()
                    except (OSError, TypeError) as e:
                        warnings.append((row["path"], str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in warnings], pa.string()) for k in (0, 1)], names=["path", "message"])

    return files.select("path", "mtime", "mode", "uid", "gid").mapInArrow(of, "path string, message string")


def write_device(pieces: DataFrame, target: str, size: int) -> None:
    """A sparse file of ``size`` bytes with each piece (at, data) in its place. A piece past the end fails the task."""
    target = local_path(target)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(target, "wb") as f:
        f.truncate(size)

    def write(rows) -> None:
        with open(target, "r+b") as f:
            for row in rows:
                if row["at"] < 0 or row["at"] + len(row["data"]) > size:
                    raise ValueError(f"{len(row['data'])} bytes at {row['at']} are past the end")
                f.seek(row["at"])
                f.write(bytes(row["data"]))

    pieces.select("at", "data").sortWithinPartitions("at").foreachPartition(write)


# --- sparse files and devices -----------------------------------------------------------------------------------


def seek_extents(path: str, most: int = MAX_EXTENT) -> Iterator[tuple[int, int]]:
    """(offset, length) of the allocated ranges, ascending, none longer than ``most``; the whole where that can't be told."""
    fd = os.open(path, os.O_RDONLY)
    try:
        size, at = os.lseek(fd, 0, os.SEEK_END), 0
        while at < size:
            try:
                begin = os.lseek(fd, at, os.SEEK_DATA)
                end = os.lseek(fd, begin, os.SEEK_HOLE)
            except OSError as e:
                if e.errno == errno.ENXIO:  # nothing but a hole is left
                    return
                begin, end = at, size
            for start in range(begin, end, most):
                yield start, min(most, end - start)
            at = end
    finally:
        os.close(fd)


def extents(devices: DataFrame, most: int = MAX_EXTENT) -> DataFrame:
    """device, extent_idx, extent_offset, extent_len for each row (device: a path that the tasks can open)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, a, n) for d in batch.column(0).to_pylist() for i, (a, n) in enumerate(seek_extents(d, most))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], names=["device", "extent_idx", "extent_offset", "extent_len"])

    return devices.select("device").mapInArrow(of, "device string, extent_idx long, extent_offset long, extent_len long")


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges`` (device, at, len) with data. A range past the device's end fails the task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for device, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fd = os.open(device, os.O_RDONLY)
                try:
                    data = os.pread(fd, n, at)
                finally:
                    os.close(fd)
                if len(data) != n:
                    raise ValueError(f"{device}: {n} bytes at {at} are past the end")
                yield pa.RecordBatch.from_arrays([pa.array([device]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["device", "at", "len", "data"])

    return ranges.select("device", "at", "len").mapInArrow(of, "device string, at long, len long, data binary")
