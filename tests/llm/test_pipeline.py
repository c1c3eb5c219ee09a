"""The pipeline's stages one after the other, and what each one removes."""

import corpus_pipeline
from paywatch.llm import decontaminate, exact_dedup, minhash, quality
from paywatch.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    sizes = [before]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < before
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    assert quality.accepted(table(spark, sf_dir, "documents"), model).count() == sizes[1]
    assert exact_dedup.exact_groups(docs).filter("group_size > 1").count() == 0
    assert minhash.near_duplicates(docs).filter("NOT kept").count() == 0
    assert decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).count() == 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = encoded.collect()
    assert len(rows) == sizes[-1] and all(r.same_text for r in rows)


def test_run_equals_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[0] == "doc_id"
