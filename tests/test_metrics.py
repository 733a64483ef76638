import math
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import metrics as M
from mailsieve.operators.report import attach_source, stratified_report

# Published confusion counts and the ratios that go with them: precision, recall, F1.
PUBLISHED = [
    ("with/overall", 108, 0, 6, 469, 1.0000, 0.9474, 0.9730),
    ("with/large", 57, 0, 6, 454, 1.0000, 0.9048, 0.9500),
    ("with/sms", 82, 0, 6, 458, 1.0000, 0.9318, 0.9647),
    ("without/overall", 110, 1, 4, 468, 0.9910, 0.9649, 0.9778),
    ("without/large", 59, 1, 4, 453, 0.9833, 0.9365, 0.9593),
    ("without/sms", 84, 1, 4, 457, 0.9882, 0.9545, 0.9711),
    ("other/overall", 112, 3, 2, 466, 0.9739, 0.9825, 0.9782),
    ("other/large", 61, 3, 2, 451, 0.9531, 0.9683, 0.9606),
    ("other/sms", 86, 3, 2, 455, 0.9663, 0.9773, 0.9718),
    ("all/small", 51, 0, 0, 15, 1.0, 1.0, 1.0),
    ("all/email", 26, 0, 0, 11, 1.0, 1.0, 1.0),
]


def _frame(spark, rows, names="g string, label int, prob_phish double"):
    return spark.createDataFrame(rows, names)


def test_published_ratios(spark):
    rows = []
    for name, tp, fp, fn, tn, *_ in PUBLISHED:
        rows += [(name, 1, 0.9)] * tp + [(name, 0, 0.8)] * fp + [(name, 1, 0.2)] * fn
        rows += [(name, 0, 0.1)] * tn
    df = _frame(spark, rows)
    counts = {r["g"]: r for r in M.confusion(df, ["g"]).collect()}
    got = {r["g"]: r for r in M.classification_metrics(df, ["g"]).collect()}
    for name, tp, fp, fn, tn, precision, recall, f1 in PUBLISHED:
        assert [counts[name][c] for c in ("tp", "fp", "fn", "tn")] == [tp, fp, fn, tn]
        row = got[name]
        found = [round(row[c], 4) for c in ("precision_phish", "recall_phish", "f1_phish")]
        assert found == [precision, recall, f1]
        assert row["n"] == tp + fp + fn + tn and row["n_phish"] == tp + fn
    assert round(got["with/overall"]["accuracy"], 4) == 0.9897
    assert round(got["without/overall"]["accuracy"], 4) == 0.9914


def test_edges(spark):
    one = M.classification_metrics(_frame(spark, [("a", 0, 0.2), ("a", 0, 0.7)])).first()
    assert math.isnan(one["roc_auc"]) and one["precision_phish"] == 0 and one["recall_phish"] == 0
    sure = M.classification_metrics(_frame(spark, [("a", 1, 0.5), ("a", 1, 0.9)])).first()
    assert sure["f1_macro"] == 1 and sure["f1_phish"] == 1 and sure["threshold"] == 0.5
    tied = _frame(spark, [("a", 0, 0.1), ("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9)])
    assert M.roc_auc(tied).first()["roc_auc"] == 0.875
    assert tied.select(M.predict_at("prob_phish").alias("p")).groupBy().sum("p").first()[0] == 3
    none = _frame(spark, [("a", 1, 0.1), ("a", 0, 0.2)])
    none = M.classification_metrics(none).first()
    assert none["f1_phish"] == 0 and none["accuracy"] == 0.5
    assert none["f1_macro"] == pytest.approx((0 + 2 / 3) / 2)


@pytest.mark.parametrize("partitions", ["1", "8", "37"])
def test_auc_against_pairs_across_slices(spark, partitions):
    rng = random.Random(3)
    rows = [
        (rng.choice("ab"), int(rng.random() < 0.3), 0.25 if rng.random() < 0.3 else round(rng.random(), 3))
        for _ in range(900)
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["g"]: r["roc_auc"] for r in M.roc_auc(_frame(spark, rows), ["g"]).collect()}
        whole = M.roc_auc(_frame(spark, rows)).first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def pairs(some):
        pos, neg = [p for _, y, p in some if y], [p for _, y, p in some if not y]
        won = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        return won / (len(pos) * len(neg))

    for g in "ab":
        assert got[g] == pytest.approx(pairs([r for r in rows if r[0] == g]), abs=1e-12)
    assert whole == pytest.approx(pairs(rows), abs=1e-12)


def test_selective(spark):
    rows = [(1, 0.9, False), (0, 0.6, True), (1, 0.2, True), (0, 0.1, False), (0, 0.7, False)]
    df = spark.createDataFrame(rows, "label int, prob_phish double, defer boolean")
    got = M.selective_metrics(df).first().asDict()
    assert got["coverage"] == 0.6 and got["n_kept"] == 3 and got["n_deferred"] == 2
    assert got["selective_accuracy"] == pytest.approx(2 / 3)
    assert got["selective_precision_phish"] == 0.5 and got["selective_recall_phish"] == 1
    assert got["selective_f1_phish"] == pytest.approx(2 / 3)
    nothing = M.selective_metrics(df.withColumn("defer", F.lit(True))).first().asDict()
    assert nothing.pop("coverage") == 0 and nothing.pop("n_kept") == 0
    assert set(nothing.values()) == {None}


def test_report(spark):
    probs = [("1", "sms", 1, 0.9), ("2", "sms", 0, 0.4), ("3", "email", 0, 0.6), ("4", "sms", 1, 0.3)]
    probs += [("5", "email", 0, 0.2), ("9", "sms", 0, 0.1)]
    split = [("1", "b"), ("2", "b"), ("3", "a"), ("4", "a"), ("5", "c")]
    joined = attach_source(
        spark.createDataFrame(probs, "id string, channel string, label int, prob_phish double"),
        spark.createDataFrame(split, "id string, source string"),
    )
    got = stratified_report(joined).collect()
    # Source c and channel email hold one label; row 9 has no source and counts elsewhere.
    assert [r["subgroup"] for r in got] == ["overall", "source=a", "source=b", "channel=sms"]
    assert [r["n"] for r in got] == [6, 2, 2, 4]
    assert [r["roc_auc"] for r in got] == [0.75, 0.0, 1.0, 0.75]
    only = stratified_report(joined.where("label = 0")).collect()
    assert [r["subgroup"] for r in only] == ["overall"] and math.isnan(only[0]["roc_auc"])


def test_evaluate_splits(spark):
    df = _frame(spark, [("val", 1, 0.9), ("val", 0, 0.1), ("test", 1, 0.1), ("test", 0, 0.9)])
    got = {r["split"]: r["roc_auc"] for r in M.evaluate_splits(df, "g").withColumnRenamed("g", "split").collect()}
    assert got == {"val": 1.0, "test": 0.0}
