"""Merkle roots, keyed log chains, chunk verification and extent layouts."""

from __future__ import annotations

from collections.abc import Iterator
from hmac import new as hmac_of

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import ZERO, branch, digest, hmac, leaf

#: Levels that one round folds: a group holds 2^LEVELS nodes at most.
LEVELS = 9


def _folded(nodes: Column) -> Column:
    """The next level: pairs become branches, an odd last node moves up as it is."""

    def up(i: Column) -> Column:
        left, right = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        return F.when(right.isNull(), left).otherwise(branch(left, right))

    return F.transform(F.sequence(F.lit(0), F.expr("0") + F.ceil(F.size(nodes) / 2).cast("int") - 1), up)


def merkle_roots(leaves: DataFrame, key: list[str], order: str, node: str) -> DataFrame:
    """``root`` and ``leaves`` (their number) for each key, of hexadecimal digests ``node`` at places ``order`` (0, 1, ...).

    A round folds aligned groups of 2^LEVELS nodes by LEVELS levels inside a task, which is what the whole tree does there, so a
    billion leaves take four shuffles and no key is gathered whole.
    """
    now = leaves.select(*key, F.col(order).cast("long").alias("__i"), leaf(F.col(node)).alias("__h"))
    total = now.groupBy(*key).agg(F.max("__i").alias("last"), F.count(F.lit(1)).alias("leaves"))
    largest = total.agg(F.max("last")).first()[0]  # one number: how many rounds
    if largest is None:
        return total.select(*key, F.lit(ZERO).alias("root"), "leaves")
    while True:
        group = now.groupBy(*key, F.shiftright("__i", LEVELS).alias("__g")).agg(F.array_sort(F.collect_list(F.struct("__i", "__h"))).alias("__n"))
        nodes = F.transform("__n", lambda x: x["__h"])
        up = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), nodes, lambda a, _: F.when(F.size(a) > 1, _folded(a)).otherwise(a))
        now = group.select(*key, F.col("__g").alias("__i"), F.get(up, F.lit(0)).alias("__h"))
        largest >>= LEVELS
        if not largest:
            break
    return now.select(*key, F.col("__h").alias("root")).join(total.drop("last"), key)


def merkle_diff(expected: DataFrame, actual: DataFrame, key: list[str], order: str, node: str) -> DataFrame:
    """Places whose leaves differ; of keys with unlike numbers of leaves, all places."""
    a = expected.select(*key, order, F.col(node).alias("__a"))
    b = actual.select(*key, order, F.col(node).alias("__b"))
    n = a.groupBy(*key).agg(F.count(F.lit(1)).alias("__na")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("__nb")), key, "full")
    both = a.join(b, [*key, order], "full").join(n, key)
    return both.filter(~F.col("__a").eqNullSafe(F.col("__b")) | ~F.col("__na").eqNullSafe(F.col("__nb"))).select(*key, order)


def signed_chain(entries: DataFrame, log: list[str], order: list[str], message: Column, key: bytes) -> DataFrame:
    """Adds idx, prev_signature and signature to the entries of each log: each signs its message and the signature before.

    Signing is sequential within a log, as the signatures are; logs are signed beside each other, each as its sorted entries come by,
    so that a task holds the signature before and no more.
    """
    own = entries.columns
    rows = entries.withColumn("__message", message).repartition(*log).sortWithinPartitions(*log, *order)
    at = [own.index(c) for c in log]
    names = [*own, "idx", "prev_signature", "signature"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, idx, last = None, 0, ""
        for batch in batches:
            new = []
            for *where, text in zip(*(batch.column(k).to_pylist() for k in at), batch.column(len(own)).to_pylist(), strict=True):
                if where != now:
                    now, idx, last = where, 0, ""
                before, last = last, hmac_of(key, "|".join([*([] if text is None else [text]), last]).encode(), "sha256").hexdigest()
                new.append((idx, before, last))
                idx += 1
            columns = [pa.array([x[k] for x in new], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *columns], names=names)

    added = [T.StructField("idx", T.LongType()), T.StructField("prev_signature", T.StringType()), T.StructField("signature", T.StringType())]
    return rows.mapInArrow(sign, T.StructType([*entries.schema.fields, *added]))


def verified_chain(entries: DataFrame, log: list[str], message: Column, key: bytes, order: str = "idx") -> DataFrame:
    """Adds ``broken`` (prev_signature isn't that of the line before) and ``tampered`` (the signature isn't the entry's)."""
    before = F.lag("signature", 1, "").over(Window.partitionBy(*log).orderBy(order))
    return entries.withColumn("broken", F.col("prev_signature") != before).withColumn("tampered", F.col("signature") != hmac(key, F.concat_ws("|", message, F.col("prev_signature"))))


def chunk_status(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """``status`` of each chunk (hash): missing, empty, altered or ok, by its blob (hash, data)."""
    both = chunks.join(blobs.select("hash", F.col("data").alias("__d"), F.lit(True).alias("__there")), "hash", "left")
    status = F.when(F.col("__there").isNull(), "missing").when(F.coalesce(F.octet_length("__d"), F.lit(0)) == 0, "empty").when(digest(F.col("__d")) != F.col("hash"), "altered").otherwise("ok")
    return both.withColumn("status", status).drop("__d", "__there")


def extent_errors(extents: DataFrame, chunks: DataFrame, device_size: str) -> DataFrame:
    """Rows (object_id, extent_idx, error) of layouts that can't be: an extent without length, one that begins before the one
    before it ends, one past the device's end, chunks that don't follow each other or don't fill their extent.

    ``extents``: object_id, extent_idx, extent_offset, extent_len and the device's size; ``chunks``: object_id, extent_idx,
    chunk_idx, rel_offset, chunk_len.
    """
    w = Window.partitionBy("object_id").orderBy("extent_idx")
    end = F.col("extent_offset") + F.col("extent_len")
    seen = extents.withColumn("__before", F.lag(end).over(w))
    inside = Window.partitionBy("object_id", "extent_idx").orderBy("chunk_idx")
    placed = chunks.withColumn("__want", F.coalesce(F.sum("chunk_len").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_extent = placed.groupBy("object_id", "extent_idx").agg(F.sum("chunk_len").alias("__sum"), F.count_if(F.col("__want") != F.col("rel_offset")).alias("__gaps"))
    all_ = seen.join(per_extent, ["object_id", "extent_idx"], "left")
    rules = [
        (F.col("extent_len") <= 0, "no length"),
        (F.col("extent_offset") < F.col("__before"), "overlap"),
        (end > F.col(device_size), "past the end"),
        (F.coalesce("__gaps", F.lit(0)) > 0, "chunks not in a row"),
        (F.coalesce("__sum", F.lit(0)) != F.col("extent_len"), "chunks do not fill"),
    ]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in rules]))
    return all_.select("object_id", "extent_idx", F.explode(errors).alias("error"))
