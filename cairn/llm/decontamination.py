"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents within a task. Its words become symbols: words of the benchmark phrases get one each, any
other word (and a document's end) is a separator, and stretches too short for any phrase are left out, as nothing can
match there. The shard's FM-index finds every phrase by backward search, locates the occurrences from sampled suffix
positions, and the hit words are merged into spans. Documents never leave their task, so there is no shuffle.

The benchmark is the query set. It goes to the tasks in blocks of at most BLOCK_BYTES bytes of text, one of which the driver holds at
a time; a larger benchmark takes one more pass over a task's documents for each block, with what earlier blocks hit carried
along, and after every CHAIN passes through a table in the shared folder, so that a task never holds more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Scratch, cut, parts_of, settled, slices, text_bytes, words
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
#: Blocks that one stage works through.
CHAIN = 4


@dataclass
class Phrases:
    """Windows of some benchmark items, as symbols 1, 2, ... of their words."""

    vocabulary: np.ndarray  # sorted hashes; symbol = place + 1
    symbols: np.ndarray  # distinct windows, right-aligned
    lengths: np.ndarray
    item_of: np.ndarray  # (window, item id) pairs, by window
    items: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str], window: int) -> Phrases:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        h, _, _, first = words(data, offsets, ALNUM)
        vocabulary, symbol = np.unique(h, return_inverse=True)
        n = np.diff(first)
        per = np.where(n > 0, np.maximum(n - window + 1, 1), 0)  # windows of each item
        of = np.repeat(np.arange(len(n)), per)
        start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(n[of], window)
        rows = np.zeros((len(of), window), np.int64)
        for j in range(window):  # right-aligned: column window - 1 is the last word
            at = length - window + j
            rows[:, j] = np.where(at >= 0, symbol[np.minimum(start + np.maximum(at, 0), max(len(h) - 1, 0))] + 1, 0) if len(h) else 0
        symbols, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        pairs = np.unique(np.stack((which.ravel(), np.asarray(ids, np.int64)[of])), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
        return cls(vocabulary, symbols, (symbols > 0).sum(axis=1).astype(np.int64), pairs[0], pairs[1])


def shard_hits(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit: for each word of the shard, whether a phrase covers it; documents and items of distinct occurring pairs)."""
    hit, none = np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(hashes):
        return hit, none, none
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[place] == hashes, place + 1, 0)
    # Stretches of known words inside documents that hold the shortest phrase.
    known = symbol > 0
    starts_doc = np.zeros(len(symbol) + 1, bool)
    starts_doc[first] = True
    begins = np.flatnonzero(known & (starts_doc[:-1] | ~np.concatenate(([False], known[:-1]))))
    ends = np.flatnonzero(known & (starts_doc[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = ends - begins >= phrases.lengths.min()
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return hit, none, none
    # The sequence: a separator before each stretch and at the end; word[p] is the shard's word at p.
    size = ends - begins + 1
    total = int(size.sum())
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    word = np.arange(total) - np.repeat(at + 1, size) + np.repeat(begins, size)
    sequence = symbol[np.maximum(word, 0)]
    sequence[at] = 0
    index = FMIndex(np.concatenate((sequence, [0])), len(phrases.vocabulary))
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    n = np.maximum(hi - lo, 0)
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    which = np.repeat(np.arange(len(n)), n)
    starts = word[index.locate(rows)]
    cover = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + phrases.lengths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(first, starts, "right") - 1
    pairs = np.unique(np.stack((doc, which)), axis=1)
    a, b = np.searchsorted(phrases.item_of, pairs[1]), np.searchsorted(phrases.item_of, pairs[1], "right")
    docs = np.repeat(pairs[0], b - a)
    item = phrases.items[np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange(len(docs))]
    both = np.unique(np.stack((docs, item)), axis=1)
    return hit, both[0], both[1]


_NAMES = ["n_words", "n_hit", "hits", "items"]
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.LongType()))]


@lru_cache(maxsize=1)
def _phrases(block: bytes, window: int) -> Phrases:
    held = pa.ipc.open_stream(block).read_all()
    return Phrases.of(held["id"].to_pylist(), held["text"].to_pylist(), window)


def _marked(text_at: int, block: Broadcast, window: int, again: bool):
    """Adds n_words, n_hit, hits and items to the rows; ``again``: to what an earlier block of phrases has marked."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(block.value, window)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            own = batch.columns[: -len(_NAMES)] if again else batch.columns
            names = [*batch.schema.names[: len(own)], *_NAMES]
            for lo, hi in slices(offsets, SHARD_BYTES):
                h, begin, end, first = words(data, offsets[lo : hi + 1], ALNUM)
                begin, end = begin - np.repeat(offsets[lo:hi], np.diff(first)), end - np.repeat(offsets[lo:hi], np.diff(first))
                hit, docs, items = shard_hits(h, first, phrases)
                listed: list[list[int]] = [[] for _ in range(hi - lo)]
                for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                    listed[d].append(i)
                if again:
                    for d, (flat, known) in enumerate(zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns[-2:]), strict=True)):
                        for a, b in zip(flat[::2], flat[1::2], strict=True):
                            hit[first[d] : first[d + 1]] |= (begin[first[d] : first[d + 1]] >= a) & (begin[first[d] : first[d + 1]] < b)
                        listed[d] = sorted({*listed[d], *known})
                spans: list[list[int]] = [[] for _ in range(hi - lo)]
                of_doc = np.concatenate(([0], np.cumsum(hit)))
                n_hit = of_doc[first[1:]] - of_doc[first[:-1]]
                for d in np.flatnonzero(n_hit).tolist():
                    a, b = first[d], first[d + 1]
                    mark = np.concatenate(([False], hit[a:b], [False]))
                    starts, ends = np.flatnonzero(mark[1:] & ~mark[:-1]), np.flatnonzero(mark[:-1] & ~mark[1:]) - 1
                    spans[d] = np.stack((begin[a + starts], end[a + ends]), axis=1).ravel().tolist()
                new = [pa.array(np.diff(first)), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in own), *new], names=names)

    return of


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The benchmark's items (id, text) in blocks of at most about ``block_bytes`` of text, each sent to the executors as it is full.
    The driver holds one block at a time; phrases are made of it in the workers. Items without id or text have none."""
    context = benchmark.sparkSession.sparkContext

    def sent(ids: list[int], texts: list[str]) -> Broadcast:
        held = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held.schema) as writer:
            writer.write_table(held)
        return context.broadcast(out.getvalue().to_pybytes())

    ids, texts, size, some = [], [], 0, False
    for row in benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += 4 * len(row[1])
        if size > block_bytes:
            yield sent(ids, texts)
            ids, texts, size, some = [], [], 0, True
    if ids or not some:
        yield sent(ids, texts)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, hits (stretches of hit words, as start and end bytes in the UTF-8 text) and items (distinct ids, sorted).

    Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lowering A-Z. A window is ``window`` consecutive words of an item, or the whole
    of a shorter one. A null or empty text has no words. Equal windows of several items list them all; repeated rows are
    marked alike. Columns of ``docs`` with the four names are replaced.
    """
    docs = docs.drop(*_NAMES)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *_FOUND])
    scratch = Scratch(docs.sparkSession, "benchmark")
    for k, block in enumerate(benchmark_blocks(benchmark, block_bytes)):
        if k and k % CHAIN == 0:
            docs = scratch.keep(docs, f"marked-{k}")
        docs = docs.mapInArrow(_marked(at, block, window, k > 0), schema)
    return docs


def remove_hits(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Takes the hit stretches out of the texts and drops the four columns. Other texts stay as they are."""
    own = [c for c in found.columns if c not in _NAMES]
    # Hits are in bytes: a text with hits is cut as a string of one character for each byte.
    text = F.when(F.size("hits") > 0, F.decode(F.col(text_col).cast("binary"), "ISO-8859-1"))
    df = found.select(*own, settled(F.col("hits")).alias("__hits"), settled(parts_of(text)).alias("__parts"), F.length(text).alias("__n"))
    k = F.sequence(F.lit(0), F.size("__hits").cast("int"), F.lit(2))
    # Kept parts lie between the stretches' ends: from hits[k - 1] (or 0) to hits[k] (or the text's end).
    a = lambda i: F.coalesce(F.get("__hits", i - 1), F.lit(0)).cast("int")
    z = lambda i: F.coalesce(F.get("__hits", i).cast("int"), F.col("__n"))
    kept = F.encode(F.array_join(F.transform(k, lambda i: cut("__parts", a(i), z(i))), ""), "ISO-8859-1").cast("string")
    out = [F.when(F.col("__parts").isNotNull(), kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in own]
    return df.select(*out)
