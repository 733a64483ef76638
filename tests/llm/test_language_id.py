from pyspark.sql import functions as F

from mailsieve.llm import language_id as L


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    train = L.training_rows(F.col("doc_id"))
    found = L.predict(docs.where(~train), L.fit(docs.where(train))).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(odd_docs, no_docs):
    model = L.fit(odd_docs)
    assert model.languages == ["en", "es"]
    rows = L.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
    assert L.predict(no_docs, model).count() == 0
    nothing = L.fit(no_docs)
    assert {r.lang_pred for r in L.predict(odd_docs, nothing).collect()} == {"und"}


def test_predictions_do_not_see_labels(odd_docs):
    model = L.fit(odd_docs)
    key = ["doc_id", "lang_pred", "score"]
    one = L.predict(odd_docs, model).select(*key).collect()
    other = L.predict(odd_docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")), model).select(*key).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_the_driver_takes_no_state_of_a_pass(spark, data, monkeypatch):
    """The shards' states meet in tasks; the driver takes the last weights, and the logits of the rows kept out."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    taken, collect = [], type(docs).collect

    def counted(df):
        rows = collect(df)
        taken.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    model = L.fit(docs)
    assert model.weights.any() and sum(taken) <= 1.5 * model.weights.nbytes
