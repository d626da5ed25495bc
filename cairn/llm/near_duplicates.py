"""Near duplicates: an LSH forest over MinHash signatures (Bawa, Condie and Ganesan, 2005), links confirmed exactly.

1. One pass over the texts gives each document its number of distinct shingles, a digest of the set, a signature of 128 MinHash
   values of 16 bits and a sketch of their lowest 4 bits. Documents of equal digest are one; the least id stands for them.
2. Forest: the values are cut into trees (16 at 85 percent, 22 at 80). Each tree is a sorted order of the documents by their
   values there. Neighbours in an order that share a first value are compared by sketch, the longer the common prefix the nearer
   they lie. Then regions: a region is a run of rows with a common prefix, and its depth follows the density: the least depth at
   which at most FEW rows share the prefix, but DEPTH at most, since a pair of similarity s shares DEPTH values in no tree with
   probability (1 - s^DEPTH)^trees <= MISS_KEYS, and a deeper prefix would miss more. All rows of a region are compared by sketch;
   a pair of s is under the sketch bound with probability MISS_SKETCH at most (``bounds``). Neither a number of rows nor the
   border of a task drops a candidate: a region that is cut, by tasks or beyond PIECE rows, is joined whole.
3. The joined documents form candidate clusters. Their texts meet there once, and all pairs of full shingle sets are compared. A
   cluster beyond ``block`` shingles is dealt to blocks of sets of like size, each with a few of the cluster's documents as hubs;
   what hubs and blocks don't bring into one class then meets in pairs of blocks (see ``_large``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, Scratch, mixed, runs, slices, small, text_bytes, words
from .components import components

SHINGLE, PERCENT = 5, 85
DEPTH, VALUES = 4, 128
#: How seldom a pair of just the least similarity shares no tree key, and how seldom its sketches agree too little.
MISS_KEYS, MISS_SKETCH = 1e-5, 4e-6
#: Rows of a region that is no deeper than it must be; rows that a task compares at once.
FEW, PIECE = 8, 1 << 14
#: Documents of a large cluster that every block of it gets.
HUBS = 8
#: Shingles of a block of a candidate cluster.
BLOCK = 400_000
#: What a document counts in a block at least, so that a block has at most BLOCK / LIGHTEST documents.
LIGHTEST = 200

_A = mixed(np.arange(1, VALUES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_X = (mixed(np.arange(1001, VALUES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PLACES = mixed(np.arange(501, 501 + 64, dtype=np.uint64)) | np.uint64(1)


@cache
def bounds(percent: int) -> tuple[int, int]:
    """(trees, least number of sketch values that agree) for pairs of similarity ``percent`` / 100 and more."""
    s = percent / 100
    trees = next((t for t in range(1, VALUES // DEPTH + 1) if (1 - s**DEPTH) ** t <= MISS_KEYS), None)
    if not trees or percent > 100:
        raise ValueError(f"percent is {percent}: {VALUES} values make too few keys for it")
    # 4-bit values of unequal MinHash agree once in 16.
    p, least, below = s + (1 - s) / 16, 0, 0.0
    while least < VALUES and (below := below + comb(VALUES, least) * p**least * (1 - p) ** (VALUES - least)) <= MISS_SKETCH:
        least += 1
    return trees, least


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingles, first of each text): sorted and distinct in a text; fewer words than ``size``: one shingle."""
    h, _, _, first = words(data, offsets, SPACED)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        m = max(len(h) - size + 1, 0)
        total = np.zeros(m, np.uint64)
        for j in range(size):
            total += h[j : j + m] * _PLACES[j]
        total = mixed(total + np.uint64(size))
        sets = []
        for a, k in zip(first[:-1].tolist(), n.tolist(), strict=True):
            if k >= size:
                own = np.sort(total[a : a + k - size + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
            else:
                sets.append(mixed(np.array([(h[a : a + k] * _PLACES[:k]).sum(dtype=np.uint64) + np.uint64(k)], dtype=np.uint64)) if k else h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, uint32 [sets, VALUES]; every set has a shingle."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), VALUES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat((low ^ _X[k]) * _A[k], starts)
    return out


_SKETCH = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("digest2", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("signature", T.BinaryType())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.int64()), ("digest2", pa.int64()), ("sketch", pa.binary()), ("signature", pa.binary())])
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in slices(offsets, 2 << 20):
            shingles, first = shingle_sets(data, offsets[lo : hi + 1])
            n = np.diff(first)
            full = np.flatnonzero(n)
            digests = np.zeros((len(n), 2), np.uint64)
            sketch, signature = [b""] * len(n), [b""] * len(n)
            if len(full):
                starts = first[:-1][full]
                with np.errstate(over="ignore"):
                    digests[full, 0] = np.add.reduceat(mixed(shingles), starts) + n[full].astype(np.uint64)
                    digests[full, 1] = np.add.reduceat(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts)
                values = _signatures(shingles, starts)
                # Minima are small numbers: their lowest bits tell them apart. Big-endian, so that bytes sort as values do.
                signed = (values & np.uint32(0xFFFF)).astype(">u2")
                low = (values & np.uint32(15)).astype(np.uint8)
                packed = (low[:, 0::2] << 4) | low[:, 1::2]
                for i, row, own in zip(full.tolist(), packed, signed, strict=True):
                    sketch[i], signature[i] = row.tobytes(), own.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n), pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)), pa.array(sketch, pa.binary()), pa.array(signature, pa.binary())], schema=schema)


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def spanning(linked) -> list[tuple[int, int]]:
    """(root, member) for a graph of n nodes; ``linked(rows)`` gives the boolean rows of its matrix."""
    n = linked.n
    free = np.ones(n, bool)
    out = []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        edge = np.array([root])
        while len(edge) and free.any():
            others = np.flatnonzero(free)
            hit = np.zeros(len(others), bool)
            for a in range(0, len(edge), 64):
                hit |= linked(edge[a : a + 64], others).any(axis=0)
            edge = others[hit]
            free[edge] = False
            out += [(root, int(x)) for x in edge]
    return out


def _agree(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    x = a ^ b
    return ((x & 15) == 0).sum(axis=-1, dtype=np.int16) + ((x >> 4) == 0).sum(axis=-1, dtype=np.int16) >= least


class _BySketch:
    def __init__(self, packed: np.ndarray, least: int):
        self.n, self.packed, self.least = len(packed), packed, least

    def __call__(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        theirs = self.packed[others]
        return np.array([_agree(theirs, self.packed[r], self.least) for r in rows])


_FOREST = T.StructType([*_LINK.fields, T.StructField("edge", T.LongType()), T.StructField("part", T.LongType())])
_FOREST_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int64()), ("part", pa.int64())])


def common_prefix(labels: np.ndarray) -> np.ndarray:
    """How many leading values each row shares with the row before it (0 for the first). ``labels``: [rows, values]."""
    same = np.zeros(labels.shape, bool)
    same[1:] = labels[1:] == labels[:-1]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def regions(shared: np.ndarray, few: int = FEW) -> np.ndarray:
    """The first rows of the regions of a sorted order, and its end, from the rows' common prefixes: runs that share the least prefix
    that ``few`` rows share at most, or DEPTH values where no shorter prefix is that rare."""
    first = np.zeros(len(shared) + 1, bool)
    first[[0, -1]] = True
    first[:-1] |= shared < 1
    for depth in range(2, DEPTH + 1):
        starts = np.flatnonzero(first)
        crowded = np.repeat(np.diff(starts) > few, np.diff(starts))
        first[:-1] |= crowded & (shared < depth)
    return np.flatnonzero(first)


def _rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least id of its component, id) for the ids of links, by halving paths in the task."""
    ids, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(ids))
    x, y = both[: len(a)], both[len(a) :]
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[root[moved]], ids[moved]


def _forest(batches: Iterator[pa.RecordBatch], least: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of candidates, from rows (tree, label, id, sketch) of one range of the forest's orders.

    The first and the last region of a range, and the pieces of a region of more than ``piece`` rows, may go on elsewhere: each of
    their rows is also told as (id, id, edge: a hash of tree and prefix, part: where it was met).
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    part = (context.partitionId() if context else 0) << 32
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    size = 0

    def told(edge: int, ids: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(np.full(len(ids), edge)), pa.array(np.full(len(ids), part))], schema=_FOREST_ARROW)

    def linked() -> pa.RecordBatch:
        nonlocal size
        x, y = _rooted(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        a.clear()
        b.clear()
        size = 0
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), none, none], schema=_FOREST_ARROW)

    def link(one: np.ndarray, other: np.ndarray) -> None:
        nonlocal size
        a.append(one)
        b.append(other)
        size += len(one)

    def compare(shared: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> None:
        starts = regions(shared)
        size = np.diff(starts)
        place = np.arange(len(ids)) - np.repeat(starts[:-1], size)
        few = np.repeat(size <= FEW, size)
        # Neighbours that share a value, whatever region they are in; then all pairs of a small region, by their distance.
        pairs = [np.flatnonzero((shared > 0) | few & (place > 0))]
        for d in range(2, FEW):
            pairs.append(np.flatnonzero(few & (place >= d)))
            if not len(pairs[-1]):
                break
        for d, later in enumerate(pairs, 1):
            for at in range(0, len(later), 1 << 14):
                x = later[at : at + (1 << 14)]
                x = x[_agree(sketch[x - d], sketch[x], least)]
                link(ids[x - d], ids[x])
        for k in np.flatnonzero(size > FEW):
            at, end = starts[k], starts[k + 1]
            found = np.array(spanning(_BySketch(sketch[at:end], least)), np.int64).reshape(-1, 2) + at
            link(ids[found[:, 0]], ids[found[:, 1]])

    def edge_of(label: np.ndarray) -> int:
        h = np.uint64(len(label))
        for v in label[: DEPTH + 1].tolist():  # the tree's number and DEPTH values
            h = mixed(np.array([int(h) ^ v], np.uint64) + np.uint64(0x9E37))[0]
        return int(h.astype(np.int64))

    kept: tuple | None = None
    first = True  # no region has begun in this range yet
    for batch in batches:
        if not batch.num_rows:
            continue
        n, width = batch.num_rows, VALUES // 2
        sketch = np.frombuffer(batch.column(3).buffers()[2], np.uint8)[width * batch.column(3).offset :][: width * n].reshape(n, width)
        label = batch.column(1)
        per = len(label[0].as_py()) // 2
        values = np.frombuffer(label.buffers()[2], ">u2")[per * label.offset :][: per * n].reshape(n, per)
        rows = (np.concatenate((batch.column(0).to_numpy()[:, None].astype(np.uint16), values.astype(np.uint16)), axis=1), batch.column(2).to_numpy(), sketch)
        if kept is not None:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
        labels, ids, sketch = rows
        # The first column is the tree, which counts as a value that all rows of a tree share.
        shared = np.maximum(common_prefix(labels) - 1, 0)
        deep = np.flatnonzero(np.concatenate(([True], shared[1:] < DEPTH)))  # where runs of DEPTH values begin
        if first:
            end = deep[1] if len(deep) > 1 else len(ids)
            yield told(edge_of(labels[0]), ids[:end], part)
            first = len(deep) < 2
        loose = np.flatnonzero(np.concatenate(([True], shared[1:] < 1)))
        cut = loose[-1] if len(ids) - loose[-1] <= piece else deep[-1]
        if len(ids) - cut > piece:
            # A region too large to be kept: it is told whole, and goes on as a region of the next part.
            yield told(edge_of(labels[cut]), ids[cut:], part)
            part, first, cut = part + 1, True, len(ids)
        if cut:
            compare(shared[:cut], ids[:cut], sketch[:cut])
        kept = (labels[cut:], ids[cut:], sketch[cut:])
        if size > 1 << 20:
            yield linked()
    if kept is not None and len(kept[1]):
        labels, ids, sketch = kept
        shared = np.maximum(common_prefix(labels) - 1, 0)
        compare(shared, ids, sketch)
        last = np.flatnonzero(np.concatenate(([True], shared[1:] < DEPTH)))[-1]
        yield told(edge_of(labels[last]), ids[last:], part)
    yield linked()


class _BySets:
    """Pairs of sets with 100 * intersection >= percent * union."""

    def __init__(self, shingles: np.ndarray, first: np.ndarray, percent: int):
        size = np.diff(first)
        self.n, self.size, self.percent = len(size), size, percent
        of = np.repeat(np.arange(len(size)), size)
        order = np.argsort(shingles, kind="stable")
        value, of = shingles[order], of[order]
        new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
        column = np.cumsum(new) - 1
        shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
        of, column = of[shared], column[shared]
        self.common = np.zeros((self.n, self.n), np.float32)
        if len(column):
            column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
            for c in range(0, int(column[-1]) + 1, 4096):
                a, b = np.searchsorted(column, (c, c + 4096))
                held = np.zeros((self.n, min(4096, int(column[-1]) + 1 - c)), np.float32)
                held[of[a:b], column[a:b] - c] = 1
                rows = np.flatnonzero(held.any(axis=1))
                held = held[rows]
                self.common[np.ix_(rows, rows)] += held @ held.T

    def __call__(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        both = self.common[np.ix_(rows, others)].astype(np.int64)
        return 100 * both >= self.percent * (self.size[rows][:, None] + self.size[others][None, :] - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for part in runs(batches, ["cluster", "i", "j"]):
        if part.num_rows < 2:
            continue
        data, offsets = text_bytes(part["text"])
        shingles, first = shingle_sets(data, offsets)
        ids = part["id"].to_numpy()
        found = spanning(_BySets(shingles, first, percent))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[a]) for a, _ in found], pa.int64()), pa.array([int(ids[b]) for _, b in found], pa.int64())], schema=_LINK_ARROW)


def _confirm(docs: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold, among the documents that ``met`` (id, cluster, i, j) brings together. A set's links span its components,
    a being the least id of its own."""
    # Few texts are in a cluster as a rule: then they are picked out where they lie, and only they move.
    inside = docs.join(small(met.select("id").distinct()), "id", "left_semi")
    texts = inside.join(met, "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    return texts.select("cluster", "i", "j", "id", "text").mapInArrow(partial(_confirmed, percent=percent), _LINK)


def _large(docs: DataFrame, rows: DataFrame, scratch: Scratch, block: int, percent: int) -> DataFrame:
    """(id, root) of the documents of clusters that are larger than a block. ``rows``: id, cluster, n_shingles.

    Sets of like size share a class: two sets that can be linked are of one class or of neighbouring ones. A class is dealt to blocks by
    a hash of the id. First each block is compared, with HUBS documents of each class beside it, so that a group of near copies
    becomes one class however large it is; a text moves once. Only if documents stay outside the cluster's largest component do pairs
    of blocks meet, those in which one holds such a document.
    """
    rows = rows.withColumn("class", F.floor(F.ln("n_shingles") / F.lit(-log(percent / 100))).cast("long"))
    blocks = rows.groupBy("cluster", "class").agg(F.ceil(F.sum(F.greatest("n_shingles", F.lit(LIGHTEST))) / F.lit(block)).cast("long").alias("n"))
    blocks = small(scratch.keep(blocks, "blocks"))
    rows = scratch.keep(rows.join(blocks, ["cluster", "class"]).select("id", "cluster", "class", "n", F.pmod(F.xxhash64("id"), F.col("n")).alias("block")), "dealt")
    pick = F.row_number().over(Window.partitionBy("cluster", "class").orderBy(F.xxhash64("id", F.lit("hub")), "id"))
    hubs = rows.select("id", "cluster", "class").distinct().withColumn("pick", pick).filter(F.col("pick") <= HUBS).select("id", "cluster", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"))
    hubs = hubs.join(blocks, ["cluster", "class"]).select("id", "cluster", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    met = rows.select("id", "cluster", "class", "block").unionByName(hubs.select("id", "cluster", "class", "block")).distinct()
    first = scratch.keep(_confirm(docs, met.select("id", "cluster", F.col("class").alias("i"), F.col("block").alias("j")), percent), "large-links")
    roots = components(first, scratch, "large")

    named = rows.join(roots, "id", "left").select(*rows.columns, F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named, "large-named")
    main = named.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    open_ = named.join(small(main), "cluster").groupBy("cluster", "class", "block").agg(F.max(F.col("root") != F.col("main")).alias("open"))
    open_ = scratch.keep(open_, "open")
    if open_.filter("open").isEmpty():
        return roots
    one, other = (open_.select(*[F.col(c).alias(f"{c}{k}") for c in open_.columns]) for k in (1, 2))
    later = (F.col("class2") == F.col("class1") + 1) | (F.col("class2") == F.col("class1")) & (F.col("block2") > F.col("block1"))
    pairs = one.join(other, (F.col("cluster1") == F.col("cluster2")) & later & (F.col("open1") | F.col("open2")))
    both = F.array(*[F.struct(F.col(f"class{k}").alias("class"), F.col(f"block{k}").alias("block")) for k in (1, 2)])
    pairs = pairs.select(F.col("cluster1").alias("cluster"), F.xxhash64("class1", "block1", "class2", "block2").alias("i"), F.inline(both))
    met = rows.join(pairs, ["cluster", "class", "block"]).select("id", "cluster", "i", F.lit(0).cast("long").alias("j")).distinct()
    return components(first.unionByName(_confirm(docs, met, percent)), scratch, "large-all")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, percent: int = PERCENT, piece: int = PIECE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``. Sets of ``percent`` similarity or more are linked.

    A set: distinct shingles of 5 words of the text with A-Z lowered; 1 to 4 words: the sequence as one; no words, or a null
    text: empty, linked with nothing. Rows of one id are one document with several texts. A row with a null id is in no
    class (component_id null) and stays (kept true). Other columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    trees, least = bounds(percent)
    per = VALUES // trees
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.keep(docs.mapInArrow(_sketched, _SKETCH), "sketches")
    some = sketches.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    # Only digests that occur more than once need a join.
    copied = some.groupBy("digest", "digest2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copied = small(scratch.keep(copied, "copied"))
    named = some.join(copied, ["digest", "digest2"], "left").select("id", "n_shingles", "sketch", "signature", F.coalesce("rep", "id").alias("rep"))
    reps = named.filter("rep = id")

    rows = reps.select("id", "sketch", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("tree", F.substring("signature", F.col("tree") * (2 * per) + 1, F.lit(2 * per)).alias("label"), "id", "sketch")
    n, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["tree", "label", "id"]
    forest = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(partial(_forest, least=least, piece=piece), _FOREST)
    forest = scratch.keep(forest, "forest")
    # A region that was met in several places is joined whole. There are at most two for each range, and one for each ``piece`` rows.
    ends = forest.filter("edge is not null").select("edge", F.col("a").alias("id"), "part")
    apart = ends.groupBy("edge").agg(F.min("id").alias("b"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("edge", "b")
    across = ends.join(F.broadcast(apart), "edge").select(F.col("id").alias("a"), "b")
    clusters = components(forest.filter("edge is null").select("a", "b").unionByName(across), scratch, "clusters")
    heads = clusters.select(F.col("root").alias("id"), F.col("root").alias("cluster")).distinct()
    members = scratch.keep(clusters.select("id", F.col("root").alias("cluster")).unionByName(heads), "members")

    sized = some.select("id", "n_shingles").join(small(members), "id").select("id", "cluster", "n_shingles")
    large = sized.groupBy("cluster").agg(F.sum(F.greatest("n_shingles", F.lit(LIGHTEST))).alias("n")).filter(F.col("n") > block).select("cluster")
    large = small(scratch.keep(large, "large-clusters"))
    usual = members.join(large, "cluster", "left_anti").select("id", "cluster", F.lit(0).alias("i"), F.lit(0).alias("j"))
    roots = _confirm(docs, usual, percent).select(F.col("b").alias("id"), F.col("a").alias("root"))
    if not large.isEmpty():
        roots = roots.unionByName(_large(docs, sized.join(large, "cluster", "left_semi"), scratch, block, percent))
    roots = scratch.keep(roots.filter("id <> root"), "roots")

    copies = named.filter("rep <> id").select("id", "rep")
    twice = named.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    if twice.filter("x <> y").isEmpty() and roots.join(twice, "id", "left_semi").isEmpty():
        moved = copies.distinct().join(small(roots.withColumnRenamed("id", "rep")), "rep", "left").select("id", F.coalesce("root", "rep").alias("component"))
        moved = moved.unionByName(roots.select("id", F.col("root").alias("component"))).distinct()
    else:
        # Rows of an id may have sets of two classes: the classes then are one component.
        links = copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        moved = components(links, scratch, "again").select("id", F.col("root").alias("component"))
    moved = small(scratch.keep(moved, "moved"))
    out = sketches.select("id", "n_shingles").join(moved, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
