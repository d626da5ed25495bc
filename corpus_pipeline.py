"""A training-data pipeline over ``documents``: quality rules, near duplicates, benchmark removal, secret removal, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns the columns of ``documents``; the
last one returns the packed pieces. An empty table gives an empty table. Columns besides those of ``documents`` are dropped, whatever
their names. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost
executor costs the stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, small, table
from cairn.llm.decontamination import find_benchmark, remove_hits
from cairn.llm.near_duplicates import near_duplicate_classes
from cairn.llm.packing import pack_documents
from cairn.llm.quality import quality
from cairn.llm.queries import vocabulary
from cairn.llm.secrets import find_secrets, redact

#: Near copies are sets of five-word shingles of similarity 0.8 and more: op5's 85 is the contract of that query alone.
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has (null text: null)."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject. Texts stay as they are.

    Null and empty texts are rejected; equal rows get equal verdicts; without trusted documents the base rules alone decide.
    """
    return quality(docs, table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate class, once. Rows without an id stay.

    Null and empty texts are linked with nothing and stay. Of equal rows one stays; of an id with several texts (whose classes count as
    one) the row of the least text, language and source.
    """
    scratch = Scratch(spark, "pipeline-near")
    classes = scratch.keep(near_duplicate_classes(docs, percent=NEAR_PERCENT).filter("doc_id is not null").select(F.col("doc_id").alias("__id"), "kept"), "classes")
    # Rows of an id that has one row, and stays, pass by without a shuffle of their text.
    gone = classes.groupBy("__id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    single = docs.join(small(gone.filter("not kept or n > 1").select("__id")), F.col("doc_id") == F.col("__id"), "left_anti")
    several = docs.join(small(gone.filter("kept and n > 1").select("__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source"))
    once = several.withColumn("__first", first).filter("__first = 1")
    return single.select(*COLUMNS).unionByName(once.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the passages of the benchmark out of the texts. Every document stays, null and empty texts as they are."""
    return _documents(remove_hits(find_benchmark(docs, table(spark, sf_dir, "benchmark"))))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret. Every document stays, null and empty texts as they are; a null source is an owner."""
    found = find_secrets(docs, Scratch(spark, "pipeline-secrets"), F.col("source"), F.concat_ws("/", "source", "lang"))
    return _documents(redact(found))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into token sequences: one row per piece. A null or empty text has the end id alone; equal rows are packed each."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", remove_benchmark),
    ("secret scan", remove_secrets),
    ("packing", pack_all),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs


#: Classifier ratios, MinHash candidates and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
