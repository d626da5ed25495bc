import re

import corpus_pipeline as cp

from . import cases
from .test_decontamination import brute_force as benchmark_hits
from .test_near_duplicates import brute_force as classes
from .test_quality_licenses import base_rules
from .test_secrets_archive import base as secret_spans


def tables(spark, folder):
    """The stages' own tables beside odd documents."""
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(cases.prose(2, 200)[50:75]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    cases.documents(spark).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_by_themselves(spark, tmp_path):
    folder = tables(spark, str(tmp_path))
    docs = cases.documents(spark)
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "secret scan", "packing"]

    good = cp.keep_good(spark, docs, folder)
    assert good.columns == columns and all(not base_rules(r.text)[5] for r in good.collect())

    once = cp.keep_one_of_each(spark, docs, folder)
    ids = sorted(r.doc_id for r in once.collect() if r.doc_id is not None)
    assert once.columns == columns and ids == sorted(i for i, c in classes([(i, t) for i, t, *_ in cases.rows()]).items() if i == c)
    assert once.filter("doc_id is null").count() == 2

    clean = cp.remove_benchmark(spark, docs, folder)
    items = [(1, " ".join(cases.prose(2, 200)[50:75]))]
    assert clean.columns == columns and clean.count() == docs.count()
    assert all(benchmark_hits(r.text, items)[1] == 0 and r.n_chars == (None if r.text is None else len(r.text)) for r in clean.collect())

    safe = cp.remove_secrets(spark, docs, folder)
    assert safe.columns == columns and safe.count() == docs.count()
    assert all(secret_spans(r.text) == [] for r in safe.collect())

    for _, stage in cp.STAGES:
        assert stage(spark, cases.empty(spark), folder).count() == 0


def test_run(spark, sf):
    out = cp.run(spark, sf).toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 2048).all()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = set(out.doc_id)
    found = classes([(i, r.text) for i, r in docs.items() if not base_rules(r.text)[5]])
    assert kept <= {i for i, c in found.items()}
    # Of what the quality rules keep, one of each class stays.
    by_class = {}
    for i in kept:
        by_class.setdefault(found[i], []).append(i)
    assert all(len(x) == 1 for x in by_class.values())


def test_other_columns_do_not_matter(spark, tmp_path):
    """Columns besides those of documents, some named like the operators' own, are not carried on and change nothing."""
    folder = tables(spark, str(tmp_path))
    for _, stage in cp.STAGES:
        plain, extra = (sorted(map(tuple, stage(spark, cases.documents(spark, extra=x), folder).collect()), key=repr) for x in (False, True))
        assert plain == extra and plain


def test_native_stages(spark, tmp_path):
    folder = tables(spark, str(tmp_path))
    for stage in (cp.keep_good, cp.remove_secrets):
        plan = stage(spark, cases.documents(spark), folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_near_copies_of_similarity_080_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id in (1, 255, 709, 944, 582, 875, 643, 770)")
    assert sorted(r.doc_id for r in cp.keep_one_of_each(spark, docs, "").collect()) == [1, 582, 643, 709]
    # Sets of 196 shingles; of 17 words changed in a row: 175 / 217 = 0.806, of 18: 174 / 218 = 0.798.
    words = cases.prose(77, 200)
    texts = [(k, " ".join([*words[:100], *(f"new{k}x{i}" for i in range(n)), *words[100 + n :]])) for k, n in ((1, 0), (2, 17), (3, 18))]
    rows = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], cases.BASE)
    assert sorted(r.doc_id for r in cp.keep_one_of_each(spark, rows, "").collect()) == [1, 3]
