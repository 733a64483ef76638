"""Metrics overall, by source and by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve.operators.metrics import metrics_of_counts, score_counts, with_ratios


def attach_source(probs: DataFrame, split: DataFrame) -> DataFrame:
    """Left join with the split's sources; only id and source of it are read."""
    return probs.join(split.select("id", "source"), "id", "left")


def stratified_report(
    scored: DataFrame, label: str = "label", prob: str = "prob_phish", threshold: float = 0.5
) -> DataFrame:
    """One row overall, then sources, then channels, each ascending.

    Rows are counted by source, channel and score first; all three levels come
    from one grouping-sets aggregate of these counts. A subgroup with a single
    label is left out, as is a null one; overall always stays.
    """
    source, channel, score = F.col("source"), F.col("channel"), F.col("_prob")
    small = score_counts(scored.select("source", "channel", prob, label), ["source", "channel"], label, prob)
    counts = small.groupingSets(
        [[score], [source, score], [channel, score]], source, channel, score
    ).agg(
        F.sum("_pos").alias("_pos"),
        F.sum("_neg").alias("_neg"),
        F.grouping("source").alias("_no_source"),
        F.grouping("channel").alias("_no_channel"),
    )
    level = F.when(F.col("_no_source") == 0, 1).when(F.col("_no_channel") == 0, 2).otherwise(0)
    counts = counts.select(
        level.alias("_level"), F.coalesce("source", "channel").alias("_key"), "_prob", "_pos", "_neg"
    ).where("_level = 0 or _key is not null")
    found = with_ratios(metrics_of_counts(counts, ["_level", "_key"], threshold))
    found = found.where("_level = 0 or (tp + fn > 0 and fp + tn > 0)")
    subgroup = (
        F.when(F.col("_level") == 1, F.concat(F.lit("source="), F.col("_key")))
        .when(F.col("_level") == 2, F.concat(F.lit("channel="), F.col("_key")))
        .otherwise(F.lit("overall"))
    )
    return found.orderBy("_level", "_key").select(
        subgroup.alias("subgroup"), "n", "accuracy", "precision_phish", "recall_phish",
        "f1_phish", "roc_auc",
    )
