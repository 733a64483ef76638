"""The driver's tables as message tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.operators.conform import conform


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a canonical message; what the assistant says counts as label 1."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.concat_ws("_", F.lit("turn"), "conv_id", "turn").alias("id"), "text",
        F.lit("sms").alias("channel"),
        (F.col("role") == "assistant").cast("int").alias("label"),
        F.concat(F.lit("src"), F.col("conv_id") % 5).alias("source"), F.lit("en").alias("lang"),
        "conv_id", "turn",
    )


def _channel():
    return F.when(F.col("n_chars") < 500, "sms").otherwise("email")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents in canonical columns.

    The narrow side is hashed, so texts are shuffled at most once and not sorted.
    """
    labels = table(spark, folder, "labels").select("doc_id", "toxic").hint("shuffle_hash")
    joined = table(spark, folder, "documents").join(labels, "doc_id")
    return conform(
        joined,
        renames={"toxic": "label"},
        constants={"id": F.concat(F.lit("doc_"), "doc_id"), "channel": _channel()},
    )


def all_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a message without a label."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), "text", _channel().alias("channel"), "source", "lang", "doc_id",
    )


def built_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Texts made of customers' columns, in which the rare cues occur."""
    key = F.col("c_custkey")
    hosts = F.array(*[F.lit(h) for h in ("ird-refund.top/x", "anz-login.info", "nzpost.com.au/x", "kiwibank-secure.co.uk", "bnz-alert.click", "ird.govt.nz", "anz.co.nz")])
    url = F.concat(F.lit("https://"), F.get(hosts, F.pmod(key, F.lit(7)).cast("int")))
    parts = [
        F.translate("c_mktsegment", "AEO", "АЕО"),
        F.when(key % 2 == 0, F.concat(F.lit("NZ$"), key, F.lit(".50"))),
        url,
        F.when(key % 3 == 0, F.concat(F.lit("http://xn--"), key, F.lit(".com"))),
    ]
    return table(spark, folder, "customer").select("c_custkey", F.concat_ws(" ", *parts).alias("text"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A probability a labelled document, by rule and with ties; no text is read."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    points = (F.col("doc_id") * 7919 + F.col("label") * 350) % 1000
    return docs.join(labels, "doc_id").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), _channel().alias("channel"), "label",
        "source", (points / F.lit(1000.0)).alias("prob_phish"), "doc_id",
    )


def rewording_provider(prompt: str) -> str:
    """Stands in for a model: answers from the text alone."""
    text = prompt.split("\n\nORIGINAL:\n", 1)[1].rsplit("\n\nRespond", 1)[0]
    return json.dumps({"paraphrases": [f"again {text}", text, f"{text} [{len(text)}]", 7]})


def length_model():
    """A model that only looks at the length of the text."""

    def predict(texts):
        z = np.array([len(t) for t in texts], dtype=float) / 1000.0 - 1.0
        p = 1.0 / (1.0 + np.exp(-z))
        return np.stack([1.0 - p, p], axis=1)

    return predict
