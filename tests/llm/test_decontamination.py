import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import decontamination as dc
from cairn.llm.fm_index import FMIndex, WaveletMatrix, suffix_order

from . import cases

A = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return A.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(text, items, window=10):
    w = words_of(text)
    hit, found = set(), set()
    for i, t in items:
        own = words_of(t)
        if i is None or not own:
            continue
        for k in range(max(1, len(own) - window + 1)):
            phrase = own[k : k + window]
            for a in range(len(w) - len(phrase) + 1):
                if w[a : a + len(phrase)] == phrase:
                    found.add(i)
                    hit.update(range(a, a + len(phrase)))
    return len(w), len(hit), sorted(found), hit


symbols = st.lists(st.integers(0, 4), max_size=60).map(lambda x: np.array([0, *x, 0]))


@given(symbols)
@settings(max_examples=200, deadline=None)
def test_suffix_order(s):
    breaks = np.cumsum(s == 0)
    spelt = [[(0, int(breaks[j])) if s[j] == 0 else (1, int(s[j])) for j in range(i, len(s))] for i in range(len(s))]
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: spelt[i])


@given(symbols)
@settings(max_examples=100, deadline=None)
def test_ranks(s):
    w = WaveletMatrix(s, 4)
    for c in range(5):
        got = w.rank(np.full(len(s) + 1, c), np.arange(len(s) + 1))
        assert got.tolist() == [int((s[:i] == c).sum()) for i in range(len(s) + 1)]


@given(symbols, st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_search_and_locate(s, phrases):
    index = FMIndex(s, 4)
    table = np.zeros((len(phrases), 4), np.int64)
    for k, p in enumerate(phrases):
        table[k, 4 - len(p) :] = p
    first, end = index.search(table, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        want = [i for i in range(len(s)) if s[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(first[k], max(first[k], end[k]))).tolist()) == want


ITEMS = [(1, " ".join(cases.prose(2, 200)[50:75])), (2, "one two"), (3, None), (4, "..."), (None, " ".join(cases.prose(1, 120)[:20])), (2, "ñandú"), (10, "a b c d e f a b c d e f"), (9, " ".join(cases.prose(2, 200)[50:61]))]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_hits_match_brute_force(spark, block):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dc.find_benchmark(cases.documents(spark, extra=True), benchmark, block_bytes=block).collect()
    assert len(out) == len(cases.rows())
    hits = 0
    for r in out:
        n, n_hit, items, hit = brute_force(r.text, ITEMS)
        assert (r.n_words, r.n_hit, r["items"]) == (n, n_hit, items)
        raw = (r.text or "").encode()
        inside = [w for a, b in zip(r.hits[::2], r.hits[1::2]) for w in words_of(raw[a:b].decode())]
        assert inside == [w for k, w in enumerate(words_of(r.text)) if k in hit]
        hits += n_hit
    assert hits > 100


def test_removal_leaves_the_rest(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.find_benchmark(cases.documents(spark), benchmark)
    before = {(r.doc_id, r.text): r for r in found.collect()}
    after = dc.remove_hits(found).collect()
    assert sorted(x for x in dc.remove_hits(found).columns) == sorted(cases.documents(spark).columns)
    for r in after:
        n, _, _, _ = brute_force(r.text, ITEMS)
        same = [k for k in before if k[0] == r.doc_id]
        assert any(n == before[k].n_words - before[k].n_hit for k in same)
    clean = [r.text for r in found.filter("n_hit = 0").collect()]
    assert set(clean) <= {r.text for r in after}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_benchmark(cases.documents(spark), none).filter("n_hit > 0").count() == 0
    assert dc.find_benchmark(cases.empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_driver_tables(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = dc.find_benchmark(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    for r in out:
        if r.n_hit or r.doc_id % 10 == 0:
            assert (r.n_words, r.n_hit, r["items"]) == brute_force(r.text, items)[:3]
