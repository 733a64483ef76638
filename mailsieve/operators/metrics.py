"""Classification, ranking and selective metrics, exact and in groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_NAN = float("nan")


def predict_at(prob: Column | str, threshold: float = 0.5) -> Column:
    prob = F.col(prob) if isinstance(prob, str) else prob
    return (prob >= F.lit(threshold)).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double, 0 over a zero denominator."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def confusion(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob_phish",
    threshold: float = 0.5,
) -> DataFrame:
    """True and false positives and negatives in one pass."""
    actual, said = F.col(label) == 1, F.col(prob) >= F.lit(threshold)
    return df.groupBy(*by).agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and both F1 from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    bottom1, bottom0 = 2 * tp + fp + fn, 2 * tn + fp + fn
    present = (bottom1 > 0).cast("int") + (bottom0 > 0).cast("int")
    f1_phish, f1_other = ratio(2 * tp, bottom1), ratio(2 * tn, bottom0)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision_phish": ratio(tp, tp + fp),
            "recall_phish": ratio(tp, tp + fn),
            "f1_phish": f1_phish,
            "f1_macro": ratio(f1_phish + f1_other, present),
            "n": tp + fp + fn + tn,
            "n_phish": tp + fn,
        }
    )


def score_counts(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob_phish"
) -> DataFrame:
    """Positives and negatives at every distinct score of a group."""
    return df.groupBy(*by, F.col(prob).alias("_prob")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )


def metrics_of_counts(counts: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Confusion counts and exact ROC AUC of every group of ``score_counts``.

    A group may be all the data, so its running sum is not left to one task.
    The distinct scores are range-partitioned, summed within each slice, and
    the slices, one row each, carry the negatives that lie below them.
    """
    by = list(by)
    sliced = counts.repartitionByRange(*by, "_prob").withColumn("_slice", F.spark_partition_id())
    below = W.partitionBy(*by, "_slice").orderBy("_prob").rowsBetween(W.unboundedPreceding, -1)
    sliced = sliced.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    said = F.col("_prob") >= F.lit(threshold)
    slices = sliced.groupBy(*by, "_slice").agg(
        F.sum("_pos").alias("_pos"),
        F.sum("_neg").alias("_neg"),
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_won"),
        F.sum(F.when(said, F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(said, F.col("_neg")).otherwise(0)).alias("_fp"),
    )
    before = W.partitionBy(*by or [F.lit(0)]).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_neg").over(before), F.lit(0)))
    return (
        slices.groupBy(*by)
        .agg(
            F.coalesce(F.sum("_tp"), F.lit(0)).alias("tp"),
            F.coalesce(F.sum("_fp"), F.lit(0)).alias("fp"),
            F.coalesce(F.sum("_pos"), F.lit(0)).alias("_p"),
            F.coalesce(F.sum("_neg"), F.lit(0)).alias("_q"),
            F.sum(F.col("_won") + F.col("_pos").cast("double") * F.col("_before")).alias("_won"),
        )
        .select(
            *by,
            "tp",
            "fp",
            (F.col("_p") - F.col("tp")).alias("fn"),
            (F.col("_q") - F.col("fp")).alias("tn"),
            F.when(
                (F.col("_p") > 0) & (F.col("_q") > 0),
                F.col("_won") / (F.col("_p").cast("double") * F.col("_q")),
            )
            .otherwise(F.lit(_NAN))
            .alias("roc_auc"),
        )
    )


def classification_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob_phish",
    threshold: float = 0.5,
) -> DataFrame:
    """All metrics of every group; AUC is NaN where one label is missing."""
    found = with_ratios(metrics_of_counts(score_counts(df, by, label, prob), by, threshold))
    return found.select(
        *by, F.lit(float(threshold)).alias("threshold"), "accuracy", "precision_phish",
        "recall_phish", "f1_phish", "f1_macro", "roc_auc", "n", "n_phish",
    )


def roc_auc(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob_phish"
) -> DataFrame:
    """Exact area under the ROC curve of every group; ties count half."""
    counts = score_counts(df, by, label, prob)
    return metrics_of_counts(counts, by, 0.5).select(*by, "roc_auc")


def evaluate_splits(
    probs: DataFrame, split: str = "split", label: str = "label", prob: str = "prob_phish",
    threshold: float = 0.5,
) -> DataFrame:
    return classification_metrics(probs, [split], label, prob, threshold)


def selective_metrics(
    df: DataFrame, defer: str = "defer", by: Sequence[str] = (), label: str = "label",
    prob: str = "prob_phish", threshold: float = 0.5,
) -> DataFrame:
    """Metrics on the rows that were kept.

    With nothing kept, coverage and n_kept are 0 and everything else is null.
    """
    keep = ~F.col(defer)
    actual, said = F.col(label) == 1, F.col(prob) >= F.lit(threshold)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("_rows"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(keep & actual & said).alias("tp"),
        F.count_if(keep & ~actual & said).alias("fp"),
        F.count_if(keep & actual & ~said).alias("fn"),
        F.count_if(keep & ~actual & ~said).alias("tn"),
    )
    some = F.col("n_kept") > 0
    return with_ratios(counts).select(
        *by,
        ratio(F.col("n_kept"), F.col("_rows")).alias("coverage"),
        "n_kept",
        F.when(some, F.col("_rows") - F.col("n_kept")).alias("n_deferred"),
        F.when(some, F.col("accuracy")).alias("selective_accuracy"),
        F.when(some, F.col("precision_phish")).alias("selective_precision_phish"),
        F.when(some, F.col("recall_phish")).alias("selective_recall_phish"),
        F.when(some, F.col("f1_phish")).alias("selective_f1_phish"),
    )
