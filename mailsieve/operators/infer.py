"""Batched inference by a model the caller brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from mailsieve.functions.text import text_or_empty


def score_with(
    messages: DataFrame, make_predict: Callable, text: str = "text", batch_size: int = 32
) -> DataFrame:
    """Adds ``probabilities`` and ``prob_phish``.

    ``make_predict`` runs once a Python worker, loads the model, and returns a
    function from an array of texts to an (n, 2) array of probabilities.
    """
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    return messages.withColumn("probabilities", predict(text_or_empty(text))).withColumn(
        "prob_phish", F.get("probabilities", F.lit(1))
    )
