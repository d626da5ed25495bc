"""Harmonic packing of token sequences (Lee and Lee, 1985) with cuts at reciprocal lengths.

A piece of length l belongs to the class k = capacity // l, and a sequence of class k holds just k pieces, so any
worker fills sequences of a class from any k of its pieces. Documents may be cut, so they are cut to make the classes
tight: whole sequences first, then pieces of exactly capacity // k, until at most ``tail`` ids are left. All pieces of a
class then have the same length, and a sequence wastes less than one id per piece it holds.

The pieces of a class are numbered without gaps by sub-groups (see gapless_rank); number // k is the sequence. Fewer than
k pieces per class stay over, a number that depends on the capacity and not on the input; they are packed first fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, gapless_rank
from .tokens import encoder

CAPACITY, END_ID, TAIL = 2048, 1, 32

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def cuts(tokens: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of a document's pieces, in order; their sum is ``tokens``."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest > tail:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, tail: int = TAIL, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit) of every piece of every document.

    ``docs`` has doc_id and text. A null or empty text has the end id alone. Texts are encoded whole.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity, tail):
                    rows.append((doc_id.as_py(), start, length, n, ids[4 * start : 4 * (start + length)]))
                    start += length
                size += len(ids)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, PIECES)


def _first_fit(capacity: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        room: list[int] = []
        bins, offsets = [], []
        for n in pdf["length"]:
            at = next((i for i, free in enumerate(room) if free >= n), len(room))
            if at == len(room):
                room.append(capacity)
            bins.append(at)
            offsets.append(capacity - room[at])
            room[at] -= n
        return pdf.assign(sequence_id=pdf["first_id"] + np.array(bins, dtype=np.int64), offset=np.array(offsets, dtype=np.int64))

    return packed


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id (0, 1, 2, ...) and offset to pieces (doc_id, start, length, ...) of at most ``capacity``."""
    pieces = pieces.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
    rows = pieces.count()
    ranked = gapless_rank(pieces, ["k"], ["doc_id", "start", *[c for c in pieces.columns if c not in ("doc_id", "start", "k")]], ["doc_id", "start"], rows)
    per_class = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` classes, so one task and a broadcast hold them.
    from pyspark.sql import Window

    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    full = F.floor(F.col("n") / F.col("k"))
    classes = per_class.withColumn("full", full).withColumn("first_id", F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn("all_full", F.sum("full").over(Window.partitionBy())).drop("n")
    ranked = scratch.keep(ranked.join(F.broadcast(classes), "k"), "ranked")
    own = [c for c in pieces.columns if c != "k"]
    whole = ranked.filter(F.col("rank") < F.col("full") * F.col("k"))
    whole = whole.select(*own, (F.col("first_id") + F.floor(F.col("rank") / F.col("k"))).cast("long").alias("sequence_id"), ((F.col("rank") % F.col("k")) * F.col("length")).cast("long").alias("offset"))
    rest = ranked.filter(F.col("rank") >= F.col("full") * F.col("k")).select(*own, F.col("all_full").cast("long").alias("first_id"))
    schema = T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest = rest.groupBy(F.lit(0).alias("__all")).applyInPandas(_first_fit(capacity), schema)
    return whole.unionByName(rest.drop("first_id"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row's text, and the end id, lies in exactly one piece; repeated rows and null ids are packed like
    others. An empty table gives an empty table. Columns besides doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = token_pieces(docs, vocabulary, capacity).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(scratch.keep(pieces, "pieces"), scratch, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to ``capacity``, from packed pieces that still carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    pad = F.unhex(F.repeat(F.hex(F.lit(pad_id.to_bytes(4, "little"))), capacity))
    return pieces.groupBy("sequence_id").agg(F.substring(F.concat(joined, pad), 1, 4 * capacity).alias("ids"))
