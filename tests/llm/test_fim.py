import hashlib

from mailsieve.llm import fim

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def check(rows):
    for r in rows:
        form, output = fim.render(r.text, r.doc_id)
        text = r.text or ""
        assert (r.form, r.n) == (form, len(text)), r.doc_id
        assert r.output_sha256 == sha(output)
        assert r.restored_sha256 == sha(fim.restore(form, output)) == sha(text)
        if form == "plain":
            assert r.prefix_chars is None and r.middle_chars is None
        else:
            assert 0 <= r.prefix_chars <= r.prefix_chars + r.middle_chars <= len(text)


def test_odd_rows_against_brute_force(odd_docs):
    rows = fim.transform(odd_docs, unit=7).collect()
    assert len(rows) == odd_docs.count()
    check(rows)
    # Clashing columns of the documents come back as they were.
    assert {r.kept for r in rows} == {"k"} and {r.size for r in rows} == {7}


def test_forms_sentinels_and_long_texts(spark):
    texts = [("é🇳🇿 " * 50_000, i) for i in range(40)] + [("has <S> inside", 1), ("<M>", 2), ("ab", 3), ("", 4)]
    docs = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    rows = fim.transform(docs, unit=1000).collect()
    check(rows)
    assert {"psm", "spm", "plain"} <= {r.form for r in rows}
    sentinels = {r.doc_id: r.form for r in rows if r.n in (3, 14)}
    assert set(sentinels.values()) == {"plain"}


def test_copies_share_one_result_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(7, "same text here")] * 50 + [(7, "other")], "doc_id long, text string")
    rows = fim.transform(docs, unit=3).collect()
    assert len(rows) == 51
    check(rows)
    assert fim.transform(no_docs).count() == 0
