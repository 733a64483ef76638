"""Duplicates by normalized text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from mailsieve.functions.text import normalize_text


def dedup_text(messages: DataFrame, order_by: Sequence[str], text: str = "text") -> DataFrame:
    """The first row, by ``order_by``, of every normalized text.

    ``order_by`` must tell all rows apart and hold no nulls. Texts are compared by SHA-256, so
    the aggregate shuffles digests, pre-aggregated in each task, and never a
    text; a text copied into a third of all rows is one digest a task. The
    rows kept are then picked by a hash semi-join on the unique order key:
    wide rows move at most once and are never sorted.
    """
    order = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    firsts = (
        messages.select(F.sha2(normalize_text(text), 256).alias("_digest"), order.alias("_order"))
        .groupBy("_digest")
        .agg(F.min("_order").alias("_first"))
    )
    if len(order_by) == 1:
        kept = firsts.select(F.col("_first").alias(order_by[0]))
    else:
        kept = firsts.select(*[F.col("_first")[name].alias(name) for name in order_by])
    return messages.join(kept.hint("shuffle_hash"), list(order_by), "left_semi").select(
        *messages.columns
    )


def dedup_summary(messages: DataFrame, text: str = "text") -> DataFrame:
    """Rows before and after, and rows dropped."""
    copies = (
        messages.select(F.sha2(normalize_text(text), 256).alias("_digest"))
        .groupBy("_digest")
        .agg(F.count("*").alias("_n"))
    )
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return copies.agg(
        total.alias("rows_before"),
        F.count("*").alias("rows_after"),
        (total - F.count("*")).alias("rows_dropped"),
    )


def source_summary(messages: DataFrame) -> DataFrame:
    """Rows and positives of every source and channel."""
    return messages.groupBy("source", "channel").agg(
        F.count("*").alias("rows"), F.sum("label").alias("n_phish")
    )
