import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import packing, sharding, tokens

from . import cases


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50), st.integers(1, 200))
@settings(max_examples=50, deadline=None)
def test_jump_hash_matches_the_loop(keys, n):
    assert sharding.jump_hash(np.array(keys, dtype=np.uint64), n).tolist() == [jump(k, n) for k in keys]


def test_only_the_new_shard_gains():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 20_000).astype(np.uint64)
    for n in (1, 7, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02


@pytest.mark.parametrize("extra", [False, True])
def test_slots_are_gapless(spark, extra):
    docs = cases.documents(spark, extra)
    out = sharding.place_in_shards(docs, "doc_id", "text", 5).collect()
    assert len(out) == len(cases.rows())
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in cases.rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    assert sharding.place_in_shards(cases.empty(spark), "doc_id", "text", 5).count() == 0


def test_many_subgroups_are_numbered_alike(spark):
    from cairn.llm.common import gapless_rank

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = gapless_rank(df, ["g"], ["id"], ["id"], 1000, per_group=20).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in out if r.g == g) == list(range(len([r for r in out if r.g == g])))


def test_write_shards(spark, tmp_path):
    sharding.write_shards(cases.documents(spark), ["doc_id"], 4, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(cases.rows())


ODD = ["", " ", "It's 'tis don't we'll 5²x½ naïve_ß ŉ Ÿ <|endoftext|> a", "Aİb", "x\x1cy", "日本語 text", "''s", "'S", "x­z", "é́", "a b", "\x00\x85", "ÀÉ ÿŸ ſ İ ĳ 1234 ¼"]


def test_ids_equal_the_librarys():
    encode = tokens.Encoder(vocabulary())
    texts = ODD + [t or "" for _, t, *_ in cases.rows()]
    for text in texts + texts[::-1]:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x250), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_librarys_on_any_text(text):
    encode = tokens.encoder(vocabulary())
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_segments_join_to_the_text(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 10)
    text = "some words of a text that-is-longer-than-one-segment and on " * 3
    assert "".join(tokens.segments(text)) == text and len(list(tokens.segments(text))) > 5


@given(st.integers(0, 100_000))
@settings(max_examples=200, deadline=None)
def test_cuts_cover_the_document(n):
    assert sum(packing.cuts(n)) == n and all(0 < x <= packing.CAPACITY for x in packing.cuts(n))


def test_every_id_is_packed_once(spark):
    docs = cases.documents(spark, extra=True)
    out = packing.pack_documents(docs, vocabulary()).toPandas()
    encode = tokens.Encoder(vocabulary())
    end = np.array([1], "<u4").tobytes()
    want = {}
    for i, t, *_ in cases.rows():
        want.setdefault(-1 if i is None else i, []).append(encode(t or "") + end)
    for i, g in out.assign(doc_id=out.doc_id.fillna(-1)).groupby("doc_id"):
        own = want[int(i)]
        assert g.length.sum() == sum(len(x) // 4 for x in own)
        for r in g.itertuples():
            assert any(zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(x) // 4 == r.doc_tokens for x in own)
    assert set(out.doc_id.fillna(-1).astype(int)) == set(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= packing.CAPACITY
    assert sorted(out.sequence_id.unique()) == list(range(out.sequence_id.nunique()))
    assert out.length.sum() / out.sequence_id.nunique() / packing.CAPACITY > 0.95
    assert packing.pack_documents(cases.empty(spark), vocabulary()).count() == 0


def test_sequences_hold_the_ids(spark):
    from cairn.llm.common import Scratch

    pieces = packing.token_pieces(cases.documents(spark).filter("doc_id in (1, 3, 7)"), vocabulary())
    scratch = Scratch(spark, "test")
    packed = scratch.keep(packing.pack(scratch.keep(pieces, "p"), scratch), "packed")
    full = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(full[r.sequence_id])[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert {len(x) for x in full.values()} == {4 * packing.CAPACITY}
