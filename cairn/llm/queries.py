"""Thin queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .decontamination import find_benchmark
from .html_text import extracted
from .licenses import license_report, templates
from .near_duplicates import near_duplicate_classes
from .oracle import ORACLE  # noqa: F401
from .packing import pack_documents
from .quality import quality
from .secrets import find_secrets, shown
from .sharding import place_in_shards
from .toxicity import learn, score
from .warc_archive import read_archive, write_archive

SHARDS = 40


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_in_shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents").select("doc_id", "text"), templates(spark))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op6_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "archive").root
    write_archive(table(spark, sf_dir, "pages"), folder)
    records = read_archive(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = find_secrets(docs, Scratch(spark, "secrets"), F.col("source"), F.concat_ws("/", "source", "lang"), keep=["doc_id"])
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"), "n_copied", "n_live")


def op9_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out recall follows the number of toxic rows to learn from: 0.56 with the 33 of sf0.01, 0.94 with the 305 of sf0.1."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    weights, bias = learn(docs, labels.select("doc_id", "toxic"), ~held_out)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_ngram_ratio": op1_ngram_ratio,
    "op2_jump_shards": op2_jump_shards,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_license_windows": op4_license_windows,
    "op5_lsh_forest": op5_lsh_forest,
    "op6_content_archive": op6_content_archive,
    "op7_fm_index": op7_fm_index,
    "op8_ownership_secrets": op8_ownership_secrets,
    "op9_nb_ngrams": op9_nb_ngrams,
    "op10_min_cut_text": op10_min_cut_text,
}
