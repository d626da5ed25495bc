"""AES-256-GCM frames as built-in expressions, and keys on the driver.

A chunk's frame: one byte 02, the key epoch (4 bytes, little endian), ciphertext and tag; its nonce comes from the chunk's hash
and the epoch, so equal chunks have equal frames. The legacy frame: 12 nonce bytes, ciphertext and tag.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

STREAMING, NONCE = b"\x02", 12


def _epoch(epoch: int) -> bytes:
    return epoch.to_bytes(4, "little")


def nonce(hash_hex: Column, epoch: int) -> Column:
    """The first 12 bytes of H(hash, epoch)."""
    return F.substring(F.unhex(F.sha2(F.concat(F.unhex(hash_hex), F.lit(_epoch(epoch))), 256)), 1, NONCE)


def seal_chunk(data: Column, hash_hex: Column, key: bytes, epoch: int) -> Column:
    # With a given nonce Spark puts it before the ciphertext; it can be derived, so the frame leaves it out.
    sealed = F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce(hash_hex, epoch))
    return F.concat(F.lit(STREAMING + _epoch(epoch)), F.substring(sealed, NONCE + 1, 2_000_000_000))


def open_chunk(frame: Column, hash_hex: Column, keys: dict[int, bytes]) -> Column:
    """The bytes, or null for a short frame, an unknown version or epoch, or bytes that were altered."""
    out = F.lit(None).cast("binary")
    body = F.substring(frame, 6, 2_000_000_000)
    for epoch, key in keys.items():
        known = F.substring(frame, 1, 5) == F.lit(STREAMING + _epoch(epoch))
        out = F.when(known & (F.octet_length(frame) >= 21), F.try_aes_decrypt(F.concat(nonce(hash_hex, epoch), body), F.lit(key), F.lit("GCM"))).otherwise(out)
    return out


def framing(frame: Column) -> Column:
    return F.when(F.substring(frame, 1, 1) == F.lit(STREAMING), "streaming").otherwise("legacy")


def seal(data: Column, key: bytes) -> Column:
    """Legacy frame with a random nonce."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"))


def open_(frame: Column, key: bytes) -> Column:
    """Of a legacy frame; null if it was altered or is too short."""
    return F.when(F.octet_length(frame) >= NONCE + 16, F.try_aes_decrypt(frame, F.lit(key), F.lit("GCM")))


def seal_text(text: Column, key: bytes) -> Column:
    return seal(F.encode(text, "UTF-8"), key)


def open_text(frame: Column, key: bytes) -> Column:
    """Null too if the bytes are not UTF-8."""
    plain = open_(frame, key)
    return F.when(F.is_valid_utf8(plain.cast("string")), F.decode(plain, "UTF-8"))


def header(data: Column, magic: bytes, version: int) -> Column:
    """The bytes after ``magic`` and a 4-byte version, or null if either is another."""
    start = magic + version.to_bytes(4, "little")
    return F.when(F.substring(data, 1, len(start)) == F.lit(start), F.substring(data, len(start) + 1, 2_000_000_000))


# --- keys, on the driver ----------------------------------------------------------------------------------------


def master_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


class Keys:
    """A data key and a metadata key, wrapped by a key from a password. ``wrapped`` is what a repository stores."""

    def __init__(self, spark, data: bytes, metadata: bytes):
        self.spark, self.data, self.metadata = spark, data, metadata

    @classmethod
    def new(cls, spark) -> Keys:
        return cls(spark, os.urandom(32), os.urandom(32))

    def wrapped(self, password: str) -> dict[str, str]:
        salt = os.urandom(16)
        row = self.spark.range(1).select(F.hex(seal(F.lit(self.data + self.metadata), master_key(password, salt)))).first()
        return {"salt": salt.hex(), "keys": row[0]}

    @classmethod
    def unwrapped(cls, spark, stored: dict[str, str], password: str) -> Keys:
        key = master_key(password, bytes.fromhex(stored["salt"]))
        both = spark.range(1).select(open_(F.lit(bytes.fromhex(stored["keys"])), key)).first()[0]
        if both is None:
            raise PermissionError("wrong password")
        return cls(spark, bytes(both[:32]), bytes(both[32:]))
