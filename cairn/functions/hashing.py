"""Digests and keyed digests as built-in expressions. ``digest`` is the one place that names the hash function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "00" * 32


def digest(data: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(data.cast("binary"), 256)


def leaf(node: Column) -> Column:
    """A Merkle leaf of a hexadecimal digest."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(node)), 256)


def branch(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256, hexadecimal, of the message's UTF-8 bytes."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def shard_key(name: Column) -> Column:
    """hh/hash: where a content-addressed store keeps a blob."""
    return F.concat(F.substring(name, 1, 2), F.lit("/"), name)


def to_hash(text: Column) -> Column:
    """The 32 bytes of 64 hexadecimal digits, else null."""
    return F.when(F.length(text) == 64, F.try_to_binary(text, F.lit("hex")))
