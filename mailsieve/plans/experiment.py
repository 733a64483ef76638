"""Fit, score, evaluate, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.operators.linear import LinearSettings, fit_text_classifier, save_model, score
from mailsieve.operators.lineage import run_folder, stored
from mailsieve.operators.metrics import evaluate_splits
from mailsieve.operators.report import attach_source, stratified_report
from mailsieve.sources.files import (
    read_probs, read_split, write_metrics, write_probs, write_report,
)


def run_experiment(
    spark: SparkSession,
    splits: str,
    out: str,
    settings: object = LinearSettings(),
    seed: int = 42,
    fit: Callable[[DataFrame, object], object] = fit_text_classifier,
    score: Callable[[DataFrame, object], DataFrame] = score,
    save: Callable[[object, str], None] | None = save_model,
) -> DataFrame:
    """Writes model, probabilities and metrics; gives the metrics of val and test.

    Any model takes part: ``fit`` makes it from the train split, ``score`` adds
    ``prob_phish`` to a split (for example by ``score_with``), ``save`` writes
    it, or is None. Metrics are computed from the written probabilities, so
    scoring runs once.
    """
    with run_folder(spark):
        began = time.time()
        model = fit(read_split(spark, splits, "train"), settings)
        seconds = time.time() - began
        if save is not None:
            save(model, f"{out}/model")
        scored = []
        for split in ("val", "test"):
            write_probs(score(read_split(spark, splits, split), model), out, split)
            scored.append(read_probs(spark, out, split).withColumn("split", F.lit(split)))
        metrics = stored(evaluate_splits(scored[0].unionByName(scored[1])), "metrics")
        config = asdict(settings) if is_dataclass(settings) else settings
        write_metrics(metrics, f"{out}/metrics", config, seed, seconds)
        rows = metrics.collect()  # a row a split
    return spark.createDataFrame(rows, metrics.schema)


def report_run(spark: SparkSession, splits: str, run: str, split: str = "test") -> DataFrame:
    """The stratified report of a run's val or test probabilities, also written."""
    if split not in ("val", "test"):
        raise ValueError(f"no report for split: {split}")
    probs = read_probs(spark, run, split)
    report = stratified_report(attach_source(probs, read_split(spark, splits, split)))
    write_report(report, f"{run}/{split}_stratified")
    return spark.read.schema(report.schema).json(f"{run}/{split}_stratified")
