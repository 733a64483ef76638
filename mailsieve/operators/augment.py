"""Paraphrases: keys, cache, provider calls and rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.constants import CANONICAL, PARAPHRASE_SOURCE, PROMPT_AFTER_TEXT, PROMPT_BEFORE_TEXT
from mailsieve.functions.hashing import cache_key
from mailsieve.functions.text import strip_whitespace
from mailsieve.operators.lineage import lookup, stored
from mailsieve.sources.cache import append_cache, cache_rows, read_cache


class QuotaExhausted(RuntimeError):
    """Raised by a provider that takes no more calls for now."""


@dataclass(frozen=True)
class ParaphraseSettings:
    model: str
    n_paraphrases: int = 4
    temperature: float = 0.9
    separator: str = ""


def with_cache_key(
    messages: DataFrame, settings: ParaphraseSettings, seed: int = 42, text: str = "text"
) -> DataFrame:
    key = cache_key(
        F.col(text), settings.model, settings.n_paraphrases, settings.temperature, seed,
        settings.separator,
    )
    return messages.withColumn("cache_key", key)


def build_prompt(text: Column, instruction: str, n_paraphrases: int) -> Column:
    """Instruction with its ``{n}`` filled, the original text, and the answer format."""
    return F.concat(
        F.lit(instruction.replace("{n}", str(n_paraphrases))),
        F.lit(PROMPT_BEFORE_TEXT),
        F.coalesce(text, F.lit("")),
        F.lit(PROMPT_AFTER_TEXT),
    )


def parse_response(raw: Column) -> Column:
    """Strings under ``paraphrases``; anything else, and bad JSON, gives none."""
    listed = F.try_variant_get(F.try_parse_json(raw), "$.paraphrases", "array<variant>")
    strings = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(strings, lambda v: F.variant_get(v, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def clean_paraphrases(paraphrases: Column, text: Column) -> Column:
    """Trimmed; without empty ones and without copies of the text in any case."""
    original = F.lower(F.coalesce(text, F.lit("")))
    trimmed = F.transform(paraphrases, strip_whitespace)
    return F.filter(trimmed, lambda p: (p != "") & (F.lower(p) != original))


def _unanswered(keyed: DataFrame, answers: DataFrame, text: str) -> DataFrame:
    """(cache_key, text) once a key; copies are dropped in each task before the shuffle."""
    asked = keyed.select("cache_key", F.coalesce(text, F.lit("")).alias(text)).distinct()
    return asked.join(answers.select("cache_key"), "cache_key", "left_anti")


def split_cached(
    keyed: DataFrame, cache: DataFrame, text: str = "text", bound: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with a cached answer, and the texts still to ask for, one row a key.

    ``bound`` is a cheaper frame that is at least as long as the cache.
    """
    answered = cache.where("paraphrases is not null")
    hits = lookup(keyed, answered, "cache_key", F.col("id"), how="inner", bound=bound)
    return hits, _unanswered(keyed, answered, text)


def _asking(provider: Callable[[str], str | None]):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = True
        for batch in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for prompt in batch["prompt"]:
                answer = error = None
                if open_:
                    try:
                        answer = provider(prompt)
                    except QuotaExhausted:
                        open_ = False
                    except Exception as failure:
                        open_, error = False, repr(failure)
                answers.append(answer)
                errors.append(error)
            yield batch.assign(raw=answers, error=errors)[["cache_key", "text", "raw", "error"]]

    return ask


def augment(
    messages: DataFrame,
    cache_path: str,
    provider: Callable[[str], str | None],
    instruction: str,
    settings: ParaphraseSettings,
    seed: int = 42,
    text: str = "text",
    parallel_calls: int = 32,
    rounds: int = 4,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Messages with ``paraphrases``, from the cache or else from the provider.

    Only missing keys, each once, reach the provider, dealt over
    ``parallel_calls`` tasks: calls take seconds, so bytes say nothing. They
    are asked for in ``rounds`` by hash of the key, and the good answers of a
    round are in the cache before the next begins, so a run that is cut short
    loses one round at most and is resumed by running it again. A failure of
    the provider other than a quota ends its task's calls, and is raised once
    the answers of the round are kept.
    """
    spark = messages.sparkSession
    keyed = with_cache_key(messages, settings, seed, text)
    prompt = build_prompt(F.col("text"), instruction, settings.n_paraphrases)
    answers = cache_rows(spark, cache_path, skip_corrupt)
    pending = stored(_unanswered(keyed, answers, text).withColumnRenamed(text, "text"), "pending")
    for number in range(rounds):
        asked = pending.where(F.pmod(F.xxhash64("cache_key"), F.lit(rounds)) == number)
        dealt = asked.repartition(parallel_calls, "cache_key").withColumn("prompt", prompt)
        replies = stored(
            dealt.mapInPandas(
                _asking(provider), "cache_key string, text string, raw string, error string"
            ),
            "replies",
        )
        parsed = replies.select(
            "cache_key",
            clean_paraphrases(parse_response(F.col("raw")), F.col("text")).alias("paraphrases"),
        )
        append_cache(parsed.where(F.size("paraphrases") > 0), cache_path)
        failed = replies.where("error is not null").select("error").head()
        if failed:
            raise RuntimeError(f"provider failed: {failed[0]}")
    found = lookup(
        keyed, read_cache(spark, cache_path, skip_corrupt), "cache_key", spread_by=F.col("id"),
        bound=cache_rows(spark, cache_path, skip_corrupt),
    )
    return found.select(
        *messages.columns,
        "cache_key",
        F.coalesce("paraphrases", F.array().cast("array<string>")).alias("paraphrases"),
    )


def expand_paraphrases(answered: DataFrame, source: str = PARAPHRASE_SOURCE) -> DataFrame:
    """One canonical row a paraphrase; rows without any are left out."""
    rows = answered.select("*", F.posexplode_outer("paraphrases").alias("_place", "_text"))
    rows = rows.where("_place is not null")
    fresh = {
        "id": F.concat("id", F.lit("__para_"), "_place"),
        "text": F.col("_text"),
        "source": F.lit(source),
    }
    return rows.select(*[fresh.get(c, F.col(c)).alias(c) for c in CANONICAL])


def augment_summary(answered: DataFrame) -> DataFrame:
    """Source rows, rows with and without paraphrases, and paraphrases."""
    size = F.size("paraphrases")
    return answered.agg(
        F.count("*").alias("source_rows"),
        F.count_if(size > 0).alias("done"),
        F.count_if(size <= 0).alias("skipped"),
        F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("paraphrased_rows"),
    )
