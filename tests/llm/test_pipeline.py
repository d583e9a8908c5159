import os

import corpus_pipeline
from fieldglass.llm import quality, simhash, substrings
from fieldglass.llm.common import clear, materialize, new_folder


def test_stages_in_turn(spark, odd_docs):
    """Each stage works on what the one before kept; all but the last return the columns of documents."""
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, before, "unused"), f"stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == list(corpus_pipeline.COLUMNS), name
        if k == 0:
            want = sorted(str(r.doc_id) for r in quality.judge(docs).filter("kept").collect())
            assert sorted(str(r.doc_id) for r in after.collect()) == want
        if k == 1:
            assert after.count() == simhash.similar_texts(before).select("group").distinct().count()
        if k == 2:
            plain = {r.doc_id: (r.kept, r.n_removed) for r in substrings.dedup_substrings(before).collect()}
            for r in after.collect():
                kept, removed = plain[r.doc_id]
                assert r.text == kept if removed else r.text.split() == kept.split()
        if k == 3:
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        before = after
    assert before.count() > 0


def test_empty_and_whole(spark, no_docs):
    docs = no_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    sizes = out.groupby("sequence_id").length.sum().sort_index()
    assert (sizes.iloc[:-1] == 4096).all() and len(out) > 50


def test_clear(spark):
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    clear(spark)
    assert not os.path.exists(path) and new_folder(spark, "x") != new_folder(spark, "x")
