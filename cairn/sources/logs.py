"""The history log (JSON lines) and small JSON stores."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hmac
from .blobs import local_path, put_file

ENTRY = "version int, timestamp long, operation string, actor string, details string, signature string, prev_signature string"
OPERATIONS = ["backup", "restore", "prune", "verify", "delete", "key_rotation", "policy_change", "other"]
STORE_VERSIONS = (1, 2)


def message(version, timestamp, operation, actor, details):
    """The text that an entry's signature covers, besides the signature before."""
    return F.concat_ws("|", version.cast("string"), timestamp.cast("string"), operation, actor, details)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """idx (from 0, blank lines aside) and the fields of each line. A line that isn't JSON fails the query and is named.

    Line numbers come from the whole text: the log is one small file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "txt")).filter(F.trim("txt") != "")
    parsed = lines.withColumn("e", F.from_json("txt", ENTRY, {"mode": "PERMISSIVE"}))
    bad = F.col("e.signature").isNull()
    parsed = parsed.withColumn("e", F.when(bad, F.raise_error(F.format_string("line %d of the history log is damaged", F.col("line") + 1)).cast(parsed.schema["e"].dataType)).otherwise(F.col("e")))
    from pyspark.sql import Window

    return parsed.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("idx"), "e.*")


def append_history(spark: SparkSession, path: str, key: bytes, timestamp: int, operation: str, actor: str, details: dict) -> dict:
    """Adds one signed line that names the signature before. One writer at a time."""
    if operation not in OPERATIONS:
        operation = "other"
    path = local_path(path)
    last = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            kept = [x for x in f if x.strip()]
        last = json.loads(kept[-1])["signature"] if kept else ""
    entry = {"version": 1, "timestamp": timestamp, "operation": operation, "actor": actor, "details": json.dumps(details, sort_keys=True)}
    text = message(*[F.lit(entry[k]) for k in ("version", "timestamp", "operation", "actor", "details")])
    entry |= {"signature": spark.range(1).select(hmac(key, F.concat_ws("|", text, F.lit(last)))).first()[0], "prev_signature": last}
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry) + "\n")
        f.flush()
        os.fsync(f.fileno())
    return entry


def load_store(path: str) -> dict:
    """The entries of a JSON store; none if it is missing. Another version than 1 or 2 is refused, version 1 read as 2."""
    try:
        with open(local_path(path), encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return {}
    if found.get("version", 1) not in STORE_VERSIONS:
        raise ValueError(f"{path}: version {found['version']} is not known")
    return found.get("entries", {})


def save_store(path: str, entries: dict) -> None:
    put_file(local_path(path), json.dumps({"version": STORE_VERSIONS[-1], "entries": entries}, sort_keys=True).encode())


class SecretStore:
    """Named secrets, each sealed, in a JSON store; names are readable without the key."""

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        self.spark, self.path, self.key = spark, path, key

    def put(self, name: str, secret: bytes) -> None:
        from ..functions.crypto import seal

        sealed = self.spark.range(1).select(F.hex(seal(F.lit(secret), self.key))).first()[0]
        save_store(self.path, load_store(self.path) | {name: sealed})

    def get(self, name: str) -> bytes | None:
        """None if there is no such name; a wrong key is an error."""
        from ..functions.crypto import open_

        sealed = load_store(self.path).get(name)
        if sealed is None:
            return None
        plain = self.spark.range(1).select(open_(F.unhex(F.lit(sealed)), self.key)).first()[0]
        if plain is None:
            raise PermissionError(f"{name} cannot be opened")
        return bytes(plain)

    def delete(self, name: str) -> None:
        save_store(self.path, {k: v for k, v in load_store(self.path).items() if k != name})

    def names(self) -> list[str]:
        return sorted(load_store(self.path))
