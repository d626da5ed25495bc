"""The chunk frame: four magic bytes, a flag (0: raw, 1: zstd) and the payload."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The frame's marks, the compression level, and how compressed formats begin.
MAGIC, RAW, ZSTD, LEVEL = b"LZC1", 0, 1, 3
PACKED_STARTS = [bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("FFD8FF"), bytes.fromhex("504B0304")]  # PNG, JPEG, ZIP


def compressible(data: Column) -> Column:
    """False for bytes that begin like a compressed format."""
    found = F.lit(False)
    for start in PACKED_STARTS:
        found = found | (F.substring(data, 1, len(start)) == F.lit(start))
    return ~found


def _with(df: DataFrame, source: str, named: list[tuple[str, T.DataType, pa.DataType]], each) -> DataFrame:
    names = [n for n, _, _ in named]
    df = df.drop(*names)
    at = df.columns.index(source)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [each(x.as_py()) for x in batch.column(at)]
            new = [pa.array([m[i] for m in made], kind) for i, (_, _, kind) in enumerate(named)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(of, T.StructType([*df.schema.fields, *(T.StructField(n, kind) for n, kind, _ in named)]))


def encode_frames(df: DataFrame, data: str, out: str) -> DataFrame:
    """Adds ``out``: the frame of the bytes, raw if they are packed already. Null stays null."""

    def each(raw: bytes | None) -> tuple:
        import zstandard

        if raw is None:
            return (None,)
        if any(raw.startswith(s) for s in PACKED_STARTS):
            return (MAGIC + bytes([RAW]) + raw,)
        return (MAGIC + bytes([ZSTD]) + zstandard.ZstdCompressor(level=LEVEL).compress(raw),)

    return _with(df, data, [(out, T.BinaryType(), pa.binary())], each)


def decode_frames(df: DataFrame, frame: str, out: str, status: str) -> DataFrame:
    """Adds ``out`` and ``status``: ok, short, unknown flag or bad payload. Bytes without the magic are a bare zstd frame."""

    def unpack(payload: bytes) -> tuple:
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(payload), "ok"
        except zstandard.ZstdError:
            return None, "bad payload"

    def each(raw: bytes | None) -> tuple:
        if raw is None:
            return None, None
        if not raw.startswith(MAGIC):
            return unpack(raw)
        if len(raw) < len(MAGIC) + 1:
            return None, "short"
        flag, payload = raw[len(MAGIC)], raw[len(MAGIC) + 1 :]
        return (payload, "ok") if flag == RAW else unpack(payload) if flag == ZSTD else (None, "unknown flag")

    return _with(df, frame, [(out, T.BinaryType(), pa.binary()), (status, T.StringType(), pa.string())], each)
