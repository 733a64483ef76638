import random
import re
import unicodedata

from pyspark.sql import functions as F

from mailsieve.functions import text as X

SAMPLES = [
    "", "   ", "Plain ASCII text", "Tēnā KOE  e\tHemi\n", "ｆｕｌｌ ＷＩＤＴＨ ＡＮＺ", "é composed é",
    "m̄ōrena", "ﬁ ligature ½ ² ª", "İstanbul ΣΑΣ ß ẞ", "한국어 텍스트", "が が", "٠١٢٣ ４５６７",
    "a b c d\x1ce\x85f", "日本語 \U0001F600 emoji", "Ω Å K", "ŉ ǆ ĳ ſ", "ấ Ệ ờ", "क़ ड़",
    "가", "x_1 y z12 9", "ŀ·", "̈́΅", "ﷺ",
]


def _texts():
    rng = random.Random(7)
    pools = [
        range(0x20, 0x7F), range(0xA0, 0x250), range(0x250, 0x530), range(0x300, 0x370),
        range(0x1E00, 0x2100), range(0x3000, 0x3100), range(0xFF00, 0xFFF0), range(0x1F300, 0x1F700),
        range(0xAC00, 0xAC80), range(0x900, 0x980), range(0x1100, 0x1200),
    ]
    made = []
    for _ in range(1500):
        pool = rng.sample(pools, 3) + [pools[0]]
        made.append("".join(chr(rng.choice(rng.choice(pool))) for _ in range(rng.randint(1, 30))))
    return SAMPLES + made


def _apply(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    named = [c.alias(f"c{k}") for k, c in enumerate(columns)]
    out = rows.select("i", *named).orderBy("i").collect()
    return [[r[f"c{k}"] for r in out] for k in range(len(columns))]


def _strip_marks(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_normal_forms_equal_python(spark):
    texts = _texts()
    lowered, nfkc, folded, spaced, stripped = _apply(
        spark, texts, F.lower("t"), X.nfkc_lower("t"), X.fold_accents("t"), X.normalize_text("t"),
        X.strip_whitespace(F.col("t")),
    )
    for t, low, a, b, c, d in zip(texts, lowered, nfkc, folded, spaced, stripped, strict=True):
        assert a == unicodedata.normalize("NFKC", t).lower(), ascii(t)
        assert b == _strip_marks(low), ascii(t)
        assert c == " ".join(low.split()), ascii(t)
        assert d == t.strip(), ascii(t)


def test_null_is_empty(spark):
    out = _apply(spark, [None], X.nfkc_lower("t"), X.fold_accents("t"), X.normalize_text("t"))
    assert out == [[""], [""], [""]]


def test_most_text_does_not_reach_python(spark):
    rows = spark.createDataFrame([("Tēnā koe, ça va? 日本",), ("plain",)], "t string")
    assert rows.where(F.col("t").rlike(X._NFKC.needs_python)).count() == 0
    assert rows.where(F.col("t").rlike(X._FOLD.needs_python)).count() == 0


def test_tokens_and_ngrams(spark):
    texts = [_strip_marks(t.lower()) for t in _texts()]
    words, one_two, two, three = _apply(
        spark, texts, X.tokens("t"), X.ngrams(X.tokens("t")), X.ngrams(X.tokens("t"), 2, 2),
        X.ngrams(X.tokens("t"), 1, 3),
    )
    for t, w, a, b, c in zip(texts, words, one_two, two, three, strict=True):
        expected = re.findall(r"(?u)\b\w\w+\b", t)
        assert w == expected, ascii(t)
        pairs = [" ".join(p) for p in zip(expected, expected[1:])]
        triples = [" ".join(p) for p in zip(expected, expected[1:], expected[2:])]
        assert (a, b, c) == (expected + pairs, pairs, expected + pairs + triples)


def test_count_terms_counts_each_once(spark):
    many = [f"t{i}x" for i in range(300)]
    got = _apply(
        spark, ["your account, account", "nothing", ""],
        X.count_terms(F.col("t"), ("acc", "count", "zzz")), X.any_term(F.col("t"), ("zzz", "acc")),
        X.count_terms(F.col("t"), many + ["acc"]), X.any_term(F.col("t"), many + ["thing"]),
        X.count_terms(F.col("t"), ()),
    )
    assert got == [[2, 0, 0], [1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 0]]


def test_both_forms_in_one_trip(spark):
    from mailsieve.functions.text import fold_accents, nfkc_lower, unicode_forms

    texts = ["plain", None, "", "Tēnā koe ﬁne ①", "e\u0301 İstanbul", "한국어 ไทย", "ＡＢＣ", "ǅ ẛ̣", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(unicode_forms("t").alias("f"), nfkc_lower("t").alias("n"), fold_accents("t").alias("a"))
    for r in both.collect():
        assert (r["f"]["nfkc"], r["f"]["fold"]) == (r["n"], r["a"])
    plan = df.select(unicode_forms("t").alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
