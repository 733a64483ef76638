"""A training corpus from raw documents, as stages that each write a table.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of the documents. Part of the ``llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.llm import bpe, jaccard_join, language_id, mixing, quality
from mailsieve.llm.frames import put_back, read, set_apart, written
from mailsieve.llm.queries import tokenizer_path

#: Least calibrated probability of the predicted language.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no text, or with a perplexity above their language's threshold, go."""
    base, names = set_apart(docs)
    judged = quality.classify(
        base, read(spark, sf_dir, "labels"), names["doc_id"], names["text"], names["lang"]
    )
    return judged.where("kept").select(*put_back(names))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of a language that the model is unsure of, go."""
    base, names = set_apart(docs)
    train = base.where(language_id.training_rows(F.col(names["doc_id"])))
    found = language_id.predict(base, language_id.fit(train, names["text"], names["lang"]), names["text"])
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*put_back(names))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    return jaccard_join.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, from not at all to three times."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document's whole text, as little-endian 32-bit integers."""
    encoded = bpe.encode(docs, tokenizer_path(), ("doc_id", "lang", "source"))
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: No stage but the mix can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
