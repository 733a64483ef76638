from functools import partial

import corpus_pipeline as P
from mailsieve.llm import bpe, jaccard_join, language_id, quality
from mailsieve.llm.frames import written


def test_stages_follow_each_other(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        found = written(stage(spark, docs, data), name)
        assert found.columns == docs.columns, name
        assert 0 < found.count() <= 3 * docs.count()
        if name != "mixing":
            assert found.exceptAll(docs).isEmpty() and found.count() <= docs.count()
        docs = found
    last = P.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count()
    assert sorted(map(str, P.run(spark, data).select("doc_id", "n_tokens").collect())) == sorted(map(str, last.select("doc_id", "n_tokens").collect()))


def test_decisions_are_those_of_the_operators(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(P.quality_stage(spark, docs, data)) == ids(quality.classify(docs, labels).where("kept"))
    assert ids(P.duplicates_stage(spark, docs, data)) == ids(jaccard_join.join(docs).where("doc_id = class_id"))


def test_odd_rows(spark, odd_docs, no_docs, data):
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES:
            found = stage(spark, docs, data)
            rows = found.collect()
            if name != "encoding":
                assert found.columns == docs.columns
            else:
                assert len(rows) == docs.count()
    assert bpe and language_id


def test_large_models_leave_documents_where_they_are(spark, data, monkeypatch, capsys):
    """The quality stage shuffles no documents and decides alike where its models are too large to be held whole."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    whole = sorted(map(str, P.quality_stage(spark, docs, data).collect()))
    small = quality.QualitySettings(model_bytes=0, chunk_chars=50_000, shard_rows=20_000)
    monkeypatch.setattr(P.quality, "classify", partial(quality.classify, settings=small))
    found = P.quality_stage(spark, docs, data)
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Exchange hash" not in plan
    assert 0 < len(whole) < docs.count() and sorted(map(str, found.collect())) == whole
