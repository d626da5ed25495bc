"""Remote stores behind an rclone program, as a Python data source (read) and plain calls (write, delete).

Gated: without the program, or with a remote that fails, reading says so. S3 needs none of this (see blobs), SFTP remotes are
rclone remotes.
"""

from __future__ import annotations

import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES, FIRST_WAIT = 3, 0.5


def run(args: list[str], data: bytes | None = None, timeout: float = 600) -> bytes:
    """Output of a program, tried three times with a doubling pause."""
    import time

    for k in range(TRIES):
        try:
            done = subprocess.run(args, input=data, capture_output=True, timeout=timeout, check=False)
        except FileNotFoundError as e:
            raise RuntimeError(f"{args[0]} is not installed") from e
        if done.returncode == 0:
            return done.stdout
        if k + 1 < TRIES:
            time.sleep(FIRST_WAIT * 2**k)
    raise RuntimeError(f"{' '.join(args[:2])} failed: {done.stderr.decode(errors='replace')[:300]}")


def remote_path(base: str, segment: str) -> str:
    segment = segment.strip("/")
    if not segment or not base:
        return base or segment
    return base + segment if base.endswith(":") else f"{base.rstrip('/')}/{segment}"


def put(remote: str, key: str, data: bytes, program: str = "rclone") -> None:
    run([program, "rcat", remote_path(remote, key)], data)


def delete(remote: str, key: str, program: str = "rclone") -> None:
    run([program, "deletefile", remote_path(remote, key)])


class _Key(InputPartition):
    def __init__(self, key: str):
        self.key = key


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.remote, self.program = options["remote"], options.get("program", "rclone")

    def partitions(self) -> list[_Key]:
        listed = run([self.program, "lsf", "--files-only", "--recursive", self.remote]).decode().splitlines()
        return [_Key(k) for k in listed] or [_Key("")]

    def read(self, partition: _Key):
        if partition.key:
            yield partition.key, run([self.program, "cat", remote_path(self.remote, partition.key)])


class RemoteBlobs(DataSource):
    """``spark.dataSource.register(RemoteBlobs)``, then ``spark.read.format("cairn_remote").option("remote", "name:path").load()``."""

    @classmethod
    def name(cls) -> str:
        return "cairn_remote"

    def schema(self) -> str:
        return "key string, data binary"

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(self.options)
