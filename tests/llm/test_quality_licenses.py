import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import licenses, quality
from cairn.llm.queries import op1_ngram_ratio

from . import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    w = W.findall(text or "")
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("extra", [False, True])
def test_base_rules_are_exact(spark, extra):
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = quality.quality(cases.documents(spark, extra), labels).collect()
    assert len(out) == len(cases.rows())
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(r.text)
        assert r.kept <= (not r.base_failed)


def test_repeats_found_by_sorting_match_those_looked_up(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(cases.prose(i, 60) * (1 + i % 3) + cases.prose(99, 40))) for i in range(12)], "doc_id long, text string")
    rated = lambda: sorted((r.doc_id, r.n_repeat_words) for r in quality.rated(docs, [0.0] * quality.BUCKETS).collect())
    looked_up = rated()
    monkeypatch.setattr(quality, "FEW", 0)
    assert rated() == looked_up == [(r.doc_id, base_rules(r.text)[4]) for r in docs.orderBy("doc_id").collect()]


def test_ratio_rejects_what_differs_from_the_target_and_keeps_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality(docs, labels).join(labels, "doc_id").filter("not base_failed")
    assert out.filter("quality = 1 and not kept").count() == 0
    assert out.filter("quality = 0 and kept").count() <= 0.1 * out.filter("quality = 0").count()


def hashed(*values):
    xxhash = pytest.importorskip("xxhash")
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) * (seed >= 1 << 63)


def grams(text):
    w = W.findall(text or "")
    return [hashed(x) for x in w] + [hashed(hashed(x), hashed(y)) for x, y in zip(w, w[1:])]


def test_query_matches_brute_force(spark, sf):
    """Scores and verdicts of the registered query over whole tables, worked out anew from distinct texts."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    trusted = {}
    for i, t in docs:
        trusted[t] = trusted.get(t, False) or i in good
    raw, target = collections.Counter(), collections.Counter()
    for t, is_good in trusted.items():
        for g in grams(t):
            raw[g % quality.BUCKETS] += 1
            target[g % quality.BUCKETS] += is_good
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log((target[b] + quality.PRIOR * share) / (share * (raw[b] + quality.PRIOR)))
    out = {r.doc_id: r for r in op1_ngram_ratio(spark, sf).collect()}
    assert len(out) == len(docs)
    for i, t in docs:
        g = grams(t)
        score = sum(ratio(x % quality.BUCKETS) for x in g) / len(g) if g else 0.0
        assert out[i].score == pytest.approx(score, abs=1e-7)
        assert out[i].kept == (not base_rules(t)[5] and score >= quality.LEAST_SCORE)


def test_ratios_match_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (None, "a")], "doc_id long, text string")
    got = quality.log_ratios(docs, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"))
    raw, target = collections.Counter(), collections.Counter()
    for i, t in [(1, "a b a"), (2, "b c"), (4, "a")]:
        for g in grams(t):
            raw[g % quality.BUCKETS] += 1
            target[g % quality.BUCKETS] += i == 1
    share = sum(target.values()) / sum(raw.values())
    for b in [*raw, 0, 1]:
        want = math.log((target[b] + quality.PRIOR * share) / (share * (raw[b] + quality.PRIOR)))
        assert got[b] == pytest.approx(want, abs=1e-8)


def test_copies_without_label_do_not_change_the_verdict(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.quality(docs, labels).join(labels.filter("quality = 1"), "doc_id", "left_semi").filter("kept")
    clean = good.select("text").distinct().orderBy("text").limit(1)
    docs = docs.join(clean, "text", "left_anti").select("doc_id", "text").unionByName(clean.select(F.lit(10**9).alias("doc_id"), "text"))
    copies = clean.select(F.explode(F.sequence(F.lit(10**9 + 1), F.lit(10**9 + docs.count() // 2))).alias("doc_id"), "text")
    trusted = labels.filter("quality = 1").select("doc_id")
    many = docs.unionByName(copies)
    ratios = quality.log_ratios(docs, trusted)
    assert quality.log_ratios(many, trusted) == ratios
    assert quality.rated(copies, ratios).filter("not kept").count() == 0
    # A label of one copy holds for the text, whichever row it is.
    one = [quality.log_ratios(many, trusted.union(spark.createDataFrame([(i,)], "doc_id long"))) for i in (10**9, 10**9 + 7)]
    assert one[0] == one[1] != ratios


def test_quality_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(cases.empty(spark), labels).count() == 0
    assert quality.quality(cases.documents(spark), labels).filter("score != 0").count() == 0


def test_no_python_in_native_plans(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for df in (quality.quality(cases.documents(spark), labels), licenses.license_report(cases.documents(spark), licenses.templates(spark))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text):
    w = ALNUM.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_licenses_match_brute_force(spark):
    rows = list(cases.rows())
    for k, (_, notice) in enumerate(licenses.NOTICES):
        words = " ".join(cases.prose(100 + k, 20))
        rows.append((100 + k, f"{words} {notice} {words}", "en", "s", 1))
        rows.append((200 + k, notice.upper(), "en", "s", 1))
        rows.append((300 + k, " ".join(notice.split()[:-1]), "en", "s", 1))
        rows.append((400 + k, notice.replace("the", "THE odd"), "en", "s", 1))
    docs = spark.createDataFrame(rows, cases.BASE)
    got = {(r.doc_id, r.template_id): r.containment for r in licenses.find_licenses(docs, licenses.templates(spark)).collect()}
    known = [shingle_set(t) for _, t in licenses.NOTICES]
    want = {}
    for i, text, *_ in rows:
        own = shingle_set(text)
        for t, s in enumerate(known):
            if len(s & own) >= licenses.CONTAINED * len(s):
                want[i, t] = len(s & own) / len(s)
    assert got == pytest.approx(want)
    assert len(want) > 2 * len(known)


def test_license_report_rows(spark):
    docs = cases.documents(spark, extra=True)
    assert licenses.license_report(docs, licenses.templates(spark)).count() == docs.count()
    assert licenses.license_report(cases.empty(spark), licenses.templates(spark)).count() == 0
    assert licenses.find_licenses(docs, licenses.templates(spark).limit(0)).count() == 0
    twice = docs.filter("doc_id = 2").withColumn("text", F.lit("Released under the MIT License."))
    assert [r.licenses for r in licenses.license_report(twice, licenses.templates(spark)).collect()] == ["MIT", "MIT"]


def test_whole_license_texts_are_found_by_either_join(spark):
    """Long templates by MinHash windows, with a word changed now and then; keys beyond the broadcast bound are shuffled."""
    full = [(i, name, text) for i, (name, text) in enumerate(licenses.NOTICES) if len(text) > 600]
    assert len(full) >= 3
    rows = []
    for i, _, text in full:
        w = text.split()
        changed = [x if k % 97 else "other" for k, x in enumerate(w)]
        rows += [(10 * i, " ".join(cases.prose(i, 300) + w + cases.prose(i + 1, 300))), (10 * i + 1, " ".join(changed)), (10 * i + 2, " ".join(w[: len(w) // 2]))]
    rows += [(None, full[0][2]), (999, None), (999, full[1][2]), (999, full[1][2])]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), licenses.templates(spark)
    want = {}
    for d, t in rows:
        mine = set(zip(*[words_of(t)[j:] for j in range(5)]))
        for i, (name, text) in enumerate(licenses.NOTICES):
            theirs = set(zip(*[words_of(text)[j:] for j in range(5)]))
            if theirs and len(mine & theirs) >= licenses.CONTAINED * len(theirs):
                want[d, i] = max(want.get((d, i), 0), len(mine & theirs) / len(theirs))
    for keys in (licenses.TEMPLATE_KEYS, 0):
        got = {(r.doc_id, r.template_id): r.containment for r in licenses.find_licenses(docs, known, broadcast_keys=keys).collect()}
        assert got == pytest.approx(want)
    assert all((10 * i, i) in want and (10 * i + 1, i) in want and (10 * i + 2, i) not in want for i, _, _ in full)


def words_of(text):
    return re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", (text or "").lower())
