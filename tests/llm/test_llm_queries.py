"""The registered queries over the driver's tables: their SQL, and what SQL can't say."""

import glob
import os
import zlib

import pytest

from cairn.llm.queries import ORACLE, QUERIES

CONTRACT = {
    "op1_ngram_ratio": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_jump_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_lsh_forest": "doc_id n_shingles component_id kept",
    "op6_content_archive": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_fm_index": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8_ownership_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_nb_ngrams": "doc_id held_out score predicted",
    "op10_min_cut_text": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert set(CONTRACT.get(name, "").split()) <= set(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_row_of_its_table(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert set(CONTRACT[name].split()) <= set(rows[0].asDict())
    key, at = ("page_id", "pages") if name.startswith("op10") else ("doc_id", "documents")
    there = [r[0] for r in spark.read.parquet(f"{sf}/{at}.parquet").select(key).collect()]
    got = {r[key] for r in rows}
    assert got == set(there) and (name.startswith("op3") or len(rows) == len(there))
    if name == "op9_nb_ngrams":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op2_jump_shards":
        assert {r.law for r in rows} == {"key"} and all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in rows)
