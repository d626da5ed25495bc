"""Cutting files and extents into chunks, and chunks into manifests."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest


def fixed_chunks(files: DataFrame, data: str, size: int) -> DataFrame:
    """A row per ``size`` bytes of the binary column ``data``: ord (0, 1, ...), chunk_offset, chunk_len and chunk bytes; the last
    chunk of a file may be short, and a null or empty file has none. The file's other columns are kept."""
    n = F.octet_length(data)
    keep = [c for c in files.columns if c != data]
    places = files.filter(n > 0).select(*keep, data, F.posexplode(F.sequence(F.lit(0), (n - 1) - (n - 1) % size, F.lit(size))).alias("ord", "at"))
    chunk = F.substring(F.col(data), F.col("at") + 1, F.lit(size))
    return places.select(*keep, F.col("ord").cast("long").alias("ord"), F.col("at").cast("long").alias("chunk_offset"), F.octet_length(chunk).cast("long").alias("chunk_len"), chunk.alias("chunk"))


def manifest(chunks: DataFrame) -> DataFrame:
    """Chunks without their bytes, named by their digest."""
    return chunks.withColumn("hash", digest(F.col("chunk"))).drop("chunk")


def split_extents(extents: DataFrame, offset: str, length: str, most: int) -> DataFrame:
    """Pieces (piece, piece_offset, piece_len) of at most ``most`` for each extent; an extent without length has none."""
    return extents.filter(F.col(length) > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((`{length}` - 1) div {most} as int)")))).select(
        "*",
        (F.col(offset) + F.col("piece") * most).cast("long").alias("piece_offset"),
        F.least(F.lit(most), F.col(length) - F.col("piece") * most).cast("long").alias("piece_len"),
    )


# --- content-defined chunks -------------------------------------------------------------------------------------

WINDOW = 64
LEAST, MEAN, MOST = 2 << 10, 8 << 10, 16 << 10


@cache
def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 64-bit words, from a seed: one for each byte value."""
    r = random.Random(seed)
    return np.array([r.getrandbits(64) for _ in range(256)], dtype=np.uint64)


def mask_of(mean: int, least: int = LEAST) -> int:
    """High bits to test, so that a boundary comes about mean - least bytes after the least length."""
    bits = max(1, round(np.log2(max(2, mean - least))))
    return ((1 << bits) - 1) << (64 - bits)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i], the sum of table[data[i - k]] << k over the last 64 bytes: what a rolling hash has at byte i, wherever it began.
    Doubling the span six times adds 1, 2, 4, ... bytes at once."""
    h = table[data]
    with np.errstate(over="ignore"):
        for k in range(6):
            step = 1 << k
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step] << np.uint64(step)
            h = h + shifted
    return h


def cut_points(data: np.ndarray, mask: int, least: int, most: int, table: np.ndarray) -> list[int]:
    """Ends of the chunks. A boundary falls after the first byte, at least ``least`` into the chunk, whose hash has no bit of the
    mask, at ``most`` bytes otherwise; a rest shorter than ``least`` joins the last chunk if that stays within ``most``, else the
    last boundary moves back to leave it ``least`` bytes."""
    n = len(data)
    marks = np.flatnonzero((gear_hashes(data, table) & np.uint64(mask)) == 0) if n > least else np.zeros(0, np.int64)
    ends: list[int] = []
    start = 0
    while start < n:
        if n - start <= least:
            end = n
        else:
            k = np.searchsorted(marks, start + least)
            end = min(int(marks[k]) + 1 if k < len(marks) else n, start + most, n)
            rest = n - end
            if 0 < rest < least:
                end = n if n - start <= most else n - least
        ends.append(end)
        start = end
    return ends


def content_chunks(files: DataFrame, data: str, least: int = LEAST, mean: int = MEAN, most: int = MOST, seed: int = 1) -> DataFrame:
    """Content-defined chunks: ord, chunk_offset, chunk_len and hash for each file; its bytes stay where they are. The file's
    other columns are kept. A null or empty file has no chunks."""
    import hashlib

    keep = [c for c in files.columns if c != data]
    fields = [f for f in files.schema.fields if f.name != data]
    mask = mask_of(mean, least)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table(seed)
        for batch in batches:
            row, order, at, length, hashes = [], [], [], [], []
            for i, cell in enumerate(batch.column(len(keep))):
                raw = cell.as_buffer() if cell.is_valid else None
                view = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
                start = 0
                for k, end in enumerate(cut_points(view, mask, least, most, table)):
                    row.append(i)
                    order.append(k)
                    at.append(start)
                    length.append(end - start)
                    hashes.append(hashlib.sha256(view[start:end]).hexdigest())
                    start = end
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in (order, at, length)), pa.array(hashes, pa.string())], names=[*keep, "ord", "chunk_offset", "chunk_len", "hash"])

    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("ord", "chunk_offset", "chunk_len")), T.StructField("hash", T.StringType())])
    return files.select(*keep, data).mapInArrow(of, schema)


def restored(chunks: DataFrame, key: list[str], data: str = "chunk", order: str = "ord") -> DataFrame:
    """Files again: the chunks of each key, in order, joined into ``content``."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    return chunks.groupBy(*key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["d"])), "")).alias("content"))


def path_objects(paths: Column) -> Column:
    """All ancestor paths of a path, itself last."""
    parts = F.split(paths, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
