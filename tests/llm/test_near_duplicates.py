import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import near_duplicates as nd
from cairn.llm.common import SPACED, Scratch, slices, text_bytes, words
from cairn.llm.components import components

from . import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = W.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(rows):
    """{id: least reachable id}; rows without id aside."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")
    out = nd.near_duplicate_classes(docs, **options).collect()
    want = brute_force(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in out) == sorted((i or -1, len(shingles(t))) for i, t in rows)


def test_case_rows(spark):
    check(spark, [(i, t) for i, t, *_ in cases.rows()])
    assert nd.near_duplicate_classes(cases.empty(spark)).count() == 0


def edited(words_, r, n):
    out = list(words_)
    for _ in range(n):
        out[r.randrange(len(out))] = r.choice(["zig", "zag", "zog"]) + str(r.randrange(1000))
    return " ".join(out)


def rows_of_groups(seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(cases.prose(1000 + i, r.randint(1, 60)))) for i in range(100)]
    for g in range(12):
        base = cases.prose(2000 + g, r.randint(20, 300))
        rows += [(1000 + 50 * g + k, edited(base, r, r.randint(0, max(1, len(base) // 40)))) for k in range(r.randint(2, 25))]
    r.shuffle(rows)
    return rows


def test_groups_of_near_copies(spark):
    check(spark, rows_of_groups())


def test_small_pieces_and_blocks_give_the_same(spark):
    """Regions beyond a piece are joined whole; clusters beyond a block meet by hubs and pairs of blocks."""
    check(spark, rows_of_groups(4), block=800, piece=3)


def test_large_clusters_without_a_common_neighbour(spark, monkeypatch):
    """A chain of near copies, each linked to the next ones alone: hubs don't join it, pairs of blocks do."""
    monkeypatch.setattr(nd, "HUBS", 1)
    words_ = cases.prose(55, 1200)
    rows = [(k, " ".join(words_[9 * k : 9 * k + 160])) for k in range(100)]
    rows += [(500 + k, edited(cases.prose(66, 160), random.Random(k), 2)) for k in range(60)]
    check(spark, rows, block=4000)


def test_regions_follow_density():
    labels = np.array([[0, 1, 1, 1, 1]] * 3 + [[0, 1, 2, 1, 1], [0, 1, 2, 1, 2]] + [[0, 2, i, 1, 1] for i in range(4)] + [[0, 3, 3, 3, 3]] * 6, np.uint16)
    shared = np.maximum(nd.common_prefix(labels) - 1, 0)
    assert shared.tolist() == [0, 4, 4, 1, 3, 0, 1, 1, 1, 0, 4, 4, 4, 4, 4]
    assert nd.regions(shared, 16).tolist() == [0, 5, 9, 15]  # few share the first value: no deeper
    assert nd.regions(shared, 4).tolist() == [0, 3, 5, 9, 15]  # five share it: two values; equal labels stay together at any number
    assert nd.regions(shared, 1).tolist() == [0, 3, 4, 5, 6, 7, 8, 9, 15]


def test_driver_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


def test_words_match_a_regular_expression():
    texts = ["", None, "a", "  ", "Ab é-x", "a" * 600_000 + " b", "x " * 400_000, "ñ" * 10, "\tq\x0b\x0cz\x1fy"]
    data, offsets = text_bytes(pa.array(texts))
    h, begin, end, first = words(data, offsets, SPACED)
    raw = data.tobytes()
    for k, text in enumerate(texts):
        got = [raw[b:e].decode() for b, e in zip(begin[first[k] : first[k + 1]], end[first[k] : first[k + 1]])]
        assert got == W.findall(text or "")
    seen = {}
    for x, b, e in zip(h.tolist(), begin, end):
        assert seen.setdefault(x, low(raw[b:e].decode())) == low(raw[b:e].decode())
    assert [x for a, b in slices(offsets, 1000) for x in range(a, b)] == list(range(len(texts)))


@pytest.mark.parametrize("seed", range(3))
def test_components_match_a_search(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {x.id: x.root for x in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    root = {}
    for a, b in links:
        if a is not None:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate((a[:370], r.integers(0, 1 << 63, 30).astype(np.uint64)))
    values = nd._signatures(np.concatenate((a, b)), np.array([0, 400]))
    assert abs((values[0] == values[1]).mean() - 370 / 430) < 0.12


@pytest.mark.parametrize(("percent", "trees"), [(85, 16), (80, 22)])
def test_bounds_miss_seldom_at_the_least_similarity(percent, trees):
    got, least = nd.bounds(percent)
    s = percent / 100
    assert got == trees and (1 - s**nd.DEPTH) ** trees <= 1e-5
    agree = np.random.default_rng(5).binomial(nd.VALUES, s + (1 - s) / 16, 1_000_000)
    assert (agree < least).sum() <= 20
    with pytest.raises(ValueError):
        nd.bounds(50)
