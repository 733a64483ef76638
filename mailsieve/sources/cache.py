"""The paraphrase cache, a parquet table that is only appended to."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.sources.files import path_exists

CACHE_SCHEMA = "cache_key string, paraphrases array<string>, written long"


def cache_rows(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """All rows that hold an answer. A missing table is empty.

    An unreadable file is an error, since its paid answers would be asked for
    again; with ``skip_corrupt`` its keys count as missing.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    table = spark.read.schema(CACHE_SCHEMA).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return table.parquet(path).where("paraphrases is not null")


def read_cache(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """One row a key: the answer written last; rows without a time are the oldest."""
    order = F.struct(F.coalesce("written", F.lit(-1)), F.to_json("paraphrases"))
    rows = cache_rows(spark, path, skip_corrupt)
    return rows.groupBy("cache_key").agg(F.max_by("paraphrases", order).alias("paraphrases"))


def append_cache(answers: DataFrame, path: str) -> None:
    """Appends with the time of writing, so that the last answer of a key wins."""
    now = F.lit(time.time_ns()).alias("written")
    answers.select("cache_key", "paraphrases", now).write.mode("append").parquet(path)
