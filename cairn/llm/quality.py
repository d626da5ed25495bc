"""Quality rules: base rules on words and lines, then a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed to 2^16 buckets. Two multinomials over the buckets are counted: the raw
corpus (every distinct text) and the trusted target (those of which a copy is labelled good), each bucket with PRIOR more
n-grams in the mean proportion, so that a few texts without a label don't tell much. A text counts once, so its verdict does
not depend on how often it was copied. A document's score is the mean over its n-grams of log(target / raw); below a fixed
threshold it goes. Built-in expressions only:

* distinct texts: 64-bit hashes are counted; only texts that occur more than once are shuffled, one copy from each task;
* counting: a partial sum of at most 2^16 buckets leaves each task;
* scoring: the 2^16 log ratios, a bounded number, are a constant of the second pass over the texts.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settled, small

BUCKETS = 1 << 16
PRIOR = 50.0
#: Documents score about 0 at the corpus' mean. Measured on good documents: -0.08 and more of 1,000 rows, -0.04 of 50,000.
LEAST_SCORE = -0.1
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Up to so many distinct repeated windows are looked up one by one; more are found by sorting.
FEW = 32


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(BUCKETS)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, text_col: str = "text") -> list[float]:
    """log(target / raw) of each bucket, from all distinct texts and those of a document whose doc_id is in ``trusted`` (doc_id)."""
    ids = small(trusted.filter("doc_id is not null").select(F.col("doc_id").alias("__id")).distinct())
    rows = docs.select("doc_id", F.col(text_col).alias("__text")).join(ids, F.col("doc_id") == F.col("__id"), "left")
    rows = rows.filter("__text <> ''").select(F.col("__id").isNotNull().alias("good"), "__text", F.xxhash64("__text").alias("__hash"))
    scratch = Scratch(docs.sparkSession, "ratios")
    copied = rows.groupBy("__hash").agg(F.bool_or("good").alias("__any"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash", "__any")
    copied = small(scratch.keep(copied, "copied"))
    once = rows.join(copied, "__hash", "left_anti").select("good", "__text")
    first = rows.join(copied, "__hash").groupBy("__hash").agg(F.first("__any").alias("good"), F.first("__text").alias("__text")).select("good", "__text")
    rows = once.unionByName(first).select("good", _words(F.col("__text")).alias("w"))
    pairs = rows.select("good", F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))))
    hashed = pairs.select("good", F.xxhash64("a").alias("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b"))
    grams = hashed.select("good", F.explode(F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b"))))).alias("bucket")).filter("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # at most BUCKETS rows
        raw[row[0]], target[row[0]] = row[1], row[2]
    scratch.drop("copied")
    if not sum(target):
        return [0.0] * BUCKETS
    share = sum(target) / sum(raw)
    return [round(log((t + PRIOR * share) / (share * (r + PRIOR))), 9) for t, r in zip(target, raw, strict=True)]


def _repeated() -> Column:
    """Places, in order, of the windows (hashes ``__t``, by place) that are among ``__dups``, the distinct repeated ones."""
    places = F.sequence(F.lit(0), F.size("__t") - 1)
    few = F.filter(places, lambda i: F.array_contains("__dups", F.get("__t", i)))
    by_value = F.array_sort(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashes = F.transform(by_value, lambda x: x["h"])
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(hashes, 1, F.size("__t") - 1))
    beside = F.zip_with(before, F.slice(hashes, 2, F.size("__t")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    marked = F.zip_with(by_value, beside, lambda v, n: F.when((v["h"] == n["x"]) | (v["h"] == n["y"]), v["i"]))
    return F.when(F.size("__dups") <= FEW, few).otherwise(F.sort_array(F.array_compact(marked)))


def rated(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), score, base_failed and kept.

    Words are [^\\x20\\x09-\\x0D]+. A null or empty text has no words, score 0, and fails the base. Rows are rated on their own.
    Columns of these names are replaced. Windows of three words are compared by 64-bit hashes.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    docs = docs.drop(*new)
    own = docs.columns
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*own, text.alias("__text"), settled(_words(text)).alias("__w"), settled(lines).alias("__lines"))
    # Long texts go no further than they must: their characters are counted here.
    word_chars, symbols = F.length(F.array_join("__w", "")).cast("long"), F.regexp_count("__text", F.lit(SYMBOLS)).cast("long")
    df = df.select(*own, word_chars.alias("word_chars"), symbols.alias("n_symbols"), "__lines", settled(F.transform("__w", lambda w: F.xxhash64(w))).alias("__h"))
    counted = ["word_chars", "n_symbols", "__lines"]
    some = lambda n, c, kind: F.when(F.size("__h") >= n, c).otherwise(F.array().cast(kind))
    windows = some(3, F.transform(F.sequence(F.lit(0), F.size("__h") - 3), lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2))), "array<bigint>")
    df = df.select(*own, *counted, "__h", settled(windows).alias("__t"))
    ordered = F.sort_array("__t")
    dups = F.array_distinct(F.array_compact(F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size("__t"), F.lit(1))), lambda a, b: F.when(a == b, a))))
    dups = F.when(F.size(F.array_distinct("__t")) < F.size("__t"), dups).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*own, *counted, "__h", "__t", settled(dups).alias("__dups"))
    df = df.select(*own, *counted, "__h", settled(F.when(F.size("__dups") > 0, _repeated())).alias("__at"))
    steps = F.zip_with("__at", F.slice("__at", 2, F.size("__at")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")

    def gram(a: Column, i: Column) -> Column:
        one, two = F.get("__h", i), F.get("__h", i + 1)
        pair = F.when(two.isNotNull(), F.get(table, _bucket(F.xxhash64(one, two)))).otherwise(0.0)
        return a + F.get(table, _bucket(one)) + pair

    n = F.size("__h")
    total = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), gram) / (2 * n - 1)).otherwise(0.0)
    df = df.select(
        *own,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__at").isNotNull(), F.aggregate(steps, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long").alias("n_repeat_words"),
        total.alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LEAST_SCORE))


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``rated`` by the ratios of the documents that ``labels`` (doc_id, quality) call good (1) to all documents.

    Rows without label, or with a null one, are raw corpus only, unless a row of equal text is good. Without good documents every ratio is 0.
    """
    return rated(docs, log_ratios(docs, labels.filter("quality = 1").select("doc_id"), text_col), text_col)
