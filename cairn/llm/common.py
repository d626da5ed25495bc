"""What the operators share: table access, scratch tables on shared storage, byte-level words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.shared import remove, shared_dir
from cairn.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables below the shared folder, which cut lineage and survive lost executors.

    ``keep`` writes a frame and reads it back; ``drop`` removes a table that no plan needs any more.
    What is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")

    def _close(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


#: Ids that may be broadcast: some 16 MB.
BROADCAST_ROWS = 1_000_000


def small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` to be joined by a broadcast if it has at most ``rows`` rows (a check that reads no more than that), else as it is."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def settled(column: Column) -> Column:
    """The column, worked out where it stands. The condition always holds; as it isn't deterministic, the optimizer neither moves a
    filter below it nor writes the expression in the place of the column. Else an array that a lambda reads might be worked
    out again for each of its elements."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def before_each(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of ``items`` (a settled array) what ``merge`` makes of the values of all elements before it: running sums,
    running maxima. ``merge`` is associative, ``zero`` its neutral element.

    Arrays grow by copying, so the elements are taken in about sqrt(n) blocks of sqrt(n): each block's total first, then the totals
    before each block, then each block by itself. An array of n elements costs some n * sqrt(n) copied numbers.
    """
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    starts = F.sequence(F.lit(1), n, F.greatest(width, F.lit(1)))
    blocks = F.transform(starts, lambda i: F.slice(items, i, width))
    empty = F.slice(F.array(zero), 1, 0)

    def running(values: Column, first: Column, of: Callable[[Column], Column]) -> Column:
        state = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(values, state, lambda a, x: F.struct(merge(a["at"], of(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: merge(a, value(x))))
    out = F.flatten(F.zip_with(blocks, running(totals, zero, lambda x: x), lambda b, first: running(b, first, value)))
    return F.when(n > 0, out).otherwise(empty)


#: Code points of a part of a text that is cut in many places.
PART = 1024


def parts_of(text: Column) -> Column:
    """The text in parts of PART code points, the last one shorter. To be settled; ``cut`` then finds a place without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def cut(parts: str, a: Column, z: Column) -> Column:
    """What stands from place ``a`` to place ``z`` (code points) of a text in ``parts_of``."""
    places = F.sequence(F.floor(a / PART).cast("int"), F.floor((z - 1) / PART).cast("int"))

    def piece(i: Column) -> Column:
        low = F.greatest(a - i * PART, F.lit(0))
        return F.substring(F.get(parts, i), low + 1, F.least(z - i * PART, F.lit(PART)) - low)

    return F.when(z > a, F.array_join(F.transform(places, piece), "")).otherwise("")


def salt_count(rows: int, per_group: int) -> int:
    """Sub-groups so that one holds about per_group rows."""
    return max(1, -(-rows // per_group))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], spread: list[str], rows: int, name: str = "rank", per_group: int = 200_000, counts_from: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each ``group``, without one task per group.

    Rows are dealt by a hash of ``spread`` to sub-groups of about ``per_group`` rows; the sub-groups' counts
    give each its first number, and a window numbers within the sub-group. ``counts_from`` may be a cheaper
    frame with the same rows (say, one that does not read the texts).
    """
    from pyspark.sql import Window

    # So many that they spread evenly over the tasks, too, whatever the groups' sizes.
    even = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(salt_count(rows, per_group), min(salt_count(rows, 1000), even))
    sub = F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int")
    df = df.withColumn("__sub", sub)
    counts = (df if counts_from is None else counts_from.withColumn("__sub", sub)).groupBy(*group, "__sub").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__sub").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(*group, "__sub").orderBy(*order)
    numbered = df.withColumn("__in", F.row_number().over(inside).cast("long") - 1)
    same = F.col("__sub") == F.col("__s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = numbered.join(firsts, same, "inner").withColumn(name, F.col("__first") + F.col("__in"))
    return out.drop("__sub", "__s", "__first", "__in", *[f"__g{i}" for i in range(len(group))])


# --- words of many texts at once, on their UTF-8 bytes ----------------------------------------------------------


def byte_class(separators: bytes) -> np.ndarray:
    """True for bytes of words. Bytes of multi-byte characters are always in words."""
    out = np.ones(256, dtype=bool)
    out[np.frombuffer(separators, dtype=np.uint8)] = False
    return out


#: Words [^\x20\x09-\x0D]+ and words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text).
SPACED = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(x.astype(np.uint64))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


_CHUNK = 1 << 19
_BASE = 0xD6E8FEB86659FD93


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, dtype=np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def _cut(data: np.ndarray, at: int, hi: int, in_word: np.ndarray) -> int:
    """The first place from ``at`` that is not inside a word."""
    while at < hi:
        outside = np.flatnonzero(~in_word[LOWER[data[at : at + 4096]]])
        if len(outside):
            return min(at + int(outside[0]), hi)
        at += 4096
    return hi


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cases A-Z and finds the words of each text: (64-bit hash, first byte, end byte) of all words, and the
    first word of each text (one more than texts). Equal words have equal hashes; the reverse holds but for chance.
    Works through the bytes in parts, so memory beyond the result is bounded but for one long word."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    found = []
    at = lo
    while at < hi:
        end = _cut(data, min(at + _CHUNK, hi), hi, in_word)
        raw = LOWER[data[at:end]]
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = in_word[raw]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        new = np.zeros(len(raw) + 1, dtype=bool)
        new[edges] = True
        begins = np.flatnonzero(inside[1:-1] & (new[:-1] | ~inside[:-2]))
        ends = np.flatnonzero(inside[1:-1] & (new[1:] | ~inside[2:])) + 1
        up, down = _powers(1 << max(20, (len(raw)).bit_length()))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], dtype=np.uint64)))
            hashes = _mixed((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        found.append((hashes, begins + at, ends + at))
        at = end
    hashes, begins, ends = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return hashes, begins, ends, np.searchsorted(begins, offsets)


def slices(offsets: np.ndarray, size: int = 4 << 20):
    """Ranges of texts of about ``size`` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = end


def runs(batches, keys: list[str], limit_rows: int | None = None):
    """Tables of the rows of one key each, from Arrow batches sorted by ``keys``. A table of just ``limit_rows`` rows may
    be followed by more rows of its key."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if kept is None else pa.concat_tables([kept, part])
        if not part.num_rows:
            continue
        starts = run_starts(part, keys)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield part.slice(a, b - a)
        kept = part.slice(starts[-1])
        while limit_rows and kept.num_rows > limit_rows:
            yield kept.slice(0, limit_rows)
            kept = kept.slice(limit_rows)
    if kept is not None and kept.num_rows:
        yield kept


def run_starts(part, keys: list[str]) -> np.ndarray:
    new = np.zeros(part.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = part[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
