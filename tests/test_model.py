import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.functions import text as X
from mailsieve.functions.cues import extract_cues
from mailsieve.constants import CUE_NAMES
from mailsieve.operators import linear as L
from mailsieve.operators import tfidf as V
from mailsieve.operators.infer import score_with
from mailsieve.operators.metrics import predict_at
from mailsieve.streaming.screen import start_scoring

# A small training frame; the last two rows hold no known term.
SMALL = [
    ("r0", "Your rates rebate of NZD 315 is waiting, claim at https://nzta-claims.example today", 1),
    ("r1", "Unpaid toll on your account, settle it at https://westpac-pay.example", 1),
    ("r2", "Kiwibank: new device added, confirm your account https://kiwibank-help.example", 1),
    ("r3", "Can you bring the blue folder on Monday? Thanks, see you Monday", 0),
    ("r4", "The plumber comes on Tuesday at ten", 0),
    ("r5", "Great match last night, call you on Tuesday", 0),
    ("r6", "x", 0),
    ("r7", None, 0),
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, t, "sms", y) for i, t, y in SMALL]
    return spark.createDataFrame(rows, "id string, text string, channel string, label int")


def _grams(text):
    words = re.findall(r"(?u)\b\w\w+\b", (text or "").lower())
    return words + [" ".join(p) for p in zip(words, words[1:])]


def _plain_tfidf(texts, min_df=1, max_df=0.95, k=None):
    docs = [Counter(_grams(t)) for t in texts]
    df, total = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        total.update(d)
    terms = [t for t in df if min_df <= df[t] <= max_df * len(docs)]
    terms = sorted(terms, key=lambda t: (-total[t], t))[:k]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in terms}
    rows = []
    for d in docs:
        w = {t: (1 + math.log(n)) * idf[t] for t, n in d.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows.append({t: x / norm for t, x in w.items()})
    return terms, idf, rows


@pytest.mark.parametrize("k", [None, 7, 25])
def test_tfidf_equals_plain(spark, messages, k):
    settings = V.TfidfSettings(min_df=1, max_features=k)
    counted = V.term_frequencies(messages, ["id"], settings=settings)
    vocabulary = V.build_vocabulary(counted, settings)
    terms, idf, rows = _plain_tfidf([t for _, t, _ in SMALL], k=k)
    got = {r["term"]: r["idf"] for r in vocabulary.collect()}
    assert got == pytest.approx({t: idf[t] for t in terms})
    weights = {(r["id"], r["term"]): r["weight"] for r in V.tfidf(counted, vocabulary, settings).collect()}
    expected = {(f"r{i}", t): w for i, row in enumerate(rows) for t, w in row.items()}
    assert weights == pytest.approx(expected)


def test_document_frequency_bounds(spark):
    two = spark.createDataFrame([("a", "spam phish click spam"), ("b", "hello phish")], "id string, text string")
    terms = lambda **kw: {r["term"] for r in V.fit_tfidf(two, settings=V.TfidfSettings(**kw)).collect()}
    assert "phish" not in terms(min_df=1, ngram_max=1)
    assert terms(min_df=2, max_df=1.0) == {"phish"}
    assert terms(min_df=2, max_df=2) == {"phish"}
    assert terms(min_df=0.6, max_df=1.0) == {"phish"}


def test_index_is_dense(spark):
    terms = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"))
    got = [r["index"] for r in V.index_terms(terms).collect()]
    assert sorted(got) == list(range(5000))


def _newton(X, y, C):
    """Penalized regression with balanced weights, solved independently."""
    n = len(y)
    s = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    A = np.hstack([X, np.ones((n, 1))])
    penalty = np.eye(A.shape[1])
    penalty[-1, -1] = 0
    w = np.zeros(A.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-A @ w))
        grad = penalty @ w + C * A.T @ (s * (p - y))
        hess = penalty + C * (A * (s * p * (1 - p))[:, None]).T @ A
        w -= np.linalg.solve(hess, grad)
    return w[:-1], w[-1]


@pytest.mark.parametrize("use_cues", [True, False])
def test_regression_against_newton(spark, messages, use_cues):
    settings = L.LinearSettings(V.TfidfSettings(min_df=1, max_features=200), use_cues=use_cues, C=2.0, tol=1e-10)
    model = L.fit_text_classifier(messages, settings)
    terms, _, rows = _plain_tfidf([t for _, t, _ in SMALL], k=200)
    X = np.array([[row.get(t, 0.0) for t in terms] for row in rows])
    if use_cues:
        cues = extract_cues(messages).orderBy("id").select(*CUE_NAMES).collect()
        X = np.hstack([X, np.array([list(r) for r in cues], dtype=float)])
    y = np.array([y for _, _, y in SMALL], dtype=float)
    w, b = _newton(X, y, 2.0)
    got = {r["term"]: r["weight"] for r in model.terms.collect()}
    assert np.allclose([got[t] for t in terms], w[: len(terms)], atol=1e-5)
    assert np.allclose(list(model.cues.values()), w[len(terms) :], atol=1e-5)
    assert abs(model.intercept - b) < 1e-5
    scored = {r["id"]: r["prob_phish"] for r in L.score(messages, model).collect()}
    expected = 1 / (1 + np.exp(-(X @ w + b)))
    assert np.allclose([scored[f"r{i}"] for i in range(len(y))], expected, atol=1e-5)
    assert expected[:3].mean() > expected[3:].mean()


def test_save_load_explain_and_stream(spark, messages, tmp_path):
    settings = L.LinearSettings(V.TfidfSettings(min_df=1, max_features=50))
    model = L.fit_text_classifier(messages, settings)
    L.save_model(model, str(tmp_path / "m"))
    loaded = L.load_model(spark, str(tmp_path / "m"))
    first = {r["id"]: r["prob_phish"] for r in L.score(messages, model).collect()}
    second = {r["id"]: r["prob_phish"] for r in L.score(messages, loaded).collect()}
    assert first == pytest.approx(second) and len(first) == len(SMALL)
    explained = L.explain_model(loaded).collect()
    sizes = [abs(r["weight"]) for r in explained]
    assert sizes == sorted(sizes, reverse=True) and len(explained) == 50 + 14
    both = L.predict_proba(messages, loaded).first()["probabilities"]
    assert len(both) == 2 and sum(both) == pytest.approx(1)
    messages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    query = start_scoring(stream, loaded, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    out = {r["id"]: r["prob_phish"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == pytest.approx(second)


def test_features_beside_each_other(spark, messages):
    settings = L.LinearSettings(V.TfidfSettings(min_df=1))
    featured = L.with_features(messages, ["id"], settings)
    long = L.assemble_features(featured, V.build_vocabulary(featured.select("terms"), settings.tfidf), settings)
    got = {(r["id"], r["feature"]): r["value"] for r in long.collect()}
    assert got[("r1", "cue=nz_lure_keyword_count")] == 1.0
    squares = sum(v * v for (i, f), v in got.items() if i == "r1" and f.startswith("term="))
    assert squares == pytest.approx(1)
    assert not any(i == "r7" for i, _ in got)


def test_fit_refuses(spark, messages):
    settings = L.LinearSettings(V.TfidfSettings(min_df=50))
    with pytest.raises(ValueError, match="no terms remain"):
        L.fit_text_classifier(messages, settings)
    settings = L.LinearSettings(V.TfidfSettings(min_df=1))
    with pytest.raises(ValueError, match="both labels"):
        L.fit_text_classifier(messages.where("label = 0"), settings)


def test_score_with_callers_model(spark, messages):
    def make():
        def predict(texts):
            p = np.array([min(len(t), 100) / 100 for t in texts], dtype=float)
            return np.stack([1 - p, p], axis=1)

        return predict

    out = score_with(messages, make, batch_size=3).withColumn("said", predict_at("prob_phish"))
    for row in out.collect():
        p = min(len(row["text"] or ""), 100) / 100
        assert row["probabilities"] == pytest.approx([1 - p, p])
        assert row["said"] == int(p >= 0.5)


def test_no_row_vanishes_for_its_keys(spark):
    rows = [("a", "sms", 1, "free prize now"), ("a", "sms", 1, "free prize now"), ("a", "sms", 1, "other words here"), (None, None, None, None),
            ("b", "email", 0, "lunch at noon"), ("b", "email", 0, "lunch at noon")]
    messages = spark.createDataFrame(rows, "id string, channel string, label int, text string")
    settings = L.LinearSettings(V.TfidfSettings(min_df=1, max_df=1.0, max_features=50), use_cues=False)
    model = L.fit_text_classifier(messages.where("label is not null"), settings)
    found = L.score(messages, model)
    assert found.count() == len(rows)
    counted = V.term_frequencies(messages, ["id"], settings=settings.tfidf)
    weights = V.tfidf(counted, model.terms, settings.tfidf)
    norms = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r["id"]: round(r["n"]) for r in norms} == {"a": 3, "b": 2}
    free = V.TfidfSettings(min_df=1, max_df=1.0, max_features=None)
    other = V.tfidf(counted, model.terms.select("term", "idf"), free)
    rounded = lambda df: sorted((r["id"], r["term"], round(r["weight"], 9)) for r in df.collect())
    assert rounded(other) == rounded(weights)
    with pytest.raises(ValueError, match="max_features"):
        L.fit_text_classifier(messages, L.LinearSettings(free))


@pytest.mark.parametrize("shortest, longest", [(1, 1), (1, 2), (2, 3), (1, 6)])
def test_ngrams_equal_a_counter(spark, shortest, longest):
    texts = ["b a ab b a", None, "", "x", "É été-ete__1 中文字 a1 a1 a1 a1", "z " * 50 + "aa a_ aA aa aa", "aa\x00bb 😀😀 ½½ aa"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    found = V.term_frequencies(frame, ["id"], settings=V.TfidfSettings(shortest, longest))
    words = {r.id: r.w for r in frame.select("id", X.tokens(X.fold_accents("text")).alias("w")).collect()}
    for r in found.collect():
        own = words[r.id]
        grams = Counter(" ".join(own[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(own) - n + 1))
        assert [(t.term, t.tf) for t in r.terms] == sorted(grams.items())


def test_a_vocabulary_reads_the_messages_once(spark, messages):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    watched = messages.select("id", "text").mapInPandas(count, "id string, text string")
    settings = V.TfidfSettings(min_df=1, max_features=5)
    assert len(V.build_vocabulary(V.term_frequencies(watched, ()), settings).collect()) == 5
    assert seen.value == len(SMALL)


def test_an_arrow_pass_takes_bounded_pieces():
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"t": ["x" * (1 << 20)] * 7 + [None, ""]})
    lists = pa.RecordBatch.from_pydict({"t": pa.array([[1] * (1 << 17)] * 5 + [[]], pa.list_(pa.int8()))})
    for batch, most in ((texts, 4), (lists, 3)):
        pieces = list(V._pieces([batch], "t"))
        assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
        assert max(p.num_rows for p in pieces) <= most and len(pieces) > 2


@pytest.mark.parametrize(("shortest", "longest"), [(1, 2), (2, 3), (1, 1), (1, 30)])
def test_words_give_the_vocabulary_and_weights_of_their_frequencies(spark, shortest, longest):
    texts = ["a one two one two three", "two three two three", "", None, "Éa éa x yy", "one two", "yy one two three one"] * 3
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    settings = V.TfidfSettings(shortest, longest, max_features=40)
    words, counted = V.message_words(frame), V.term_frequencies(frame, settings=settings)
    vocabulary = V.build_vocabulary(counted, settings)
    assert sorted(V.build_vocabulary(words, settings).collect()) == sorted(vocabulary.collect())
    weighed = lambda f: [(r.id, [(w.term, round(w.value, 12)) for w in r.weights]) for r in sorted(V.weigh_terms(f, vocabulary, settings).collect())]
    assert weighed(words) == weighed(counted)
    loose = V.TfidfSettings(shortest, longest, max_features=None)
    long = lambda f, s: sorted((r.id, r.term, round(r.weight, 12)) for r in V.tfidf(f, vocabulary, s).collect())
    assert long(words, settings) == long(counted, settings) == long(words, loose)


def test_counting_words_sends_a_term_once_a_piece(spark):
    """The statistics' exchange takes a row a term and piece, not one a message and term."""
    frame = spark.range(2_000).selectExpr("id", "'one two three four' as text").coalesce(1)
    rows = V._counted_words(V.message_words(frame), V.TfidfSettings())
    assert {r.term: (r.df, r.total) for r in rows.where("term is not null").collect()}["two three"] == (2_000, 2_000)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert rows.agg(F.sum("firsts")).head()[0] == 2_000
