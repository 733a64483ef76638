"""Seeded hashes: the only source of randomness in this package."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """SHA-256 hex of the seed and the parts, joined by a bar."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash32(seed: int | str, *parts: Column) -> Column:
    """The first 32 bits of ``seeded_hash`` as a non-negative number."""
    return F.conv(F.substring(seeded_hash(seed, *parts), 1, 8), 16, 10).cast("bigint")


def seeded_choice(options: Column, seed: int | str, *parts: Column) -> Column:
    """One element of the array, picked evenly by hash."""
    place = F.pmod(hash32(seed, *parts), F.size(options).cast("bigint"))
    return F.get(options, place.cast("int"))


def cache_key(
    text: Column, model: str, n_paraphrases: int, temperature: float, seed: int,
    separator: str = "",
) -> Column:
    """SHA-256 hex over text and settings.

    The default runs the fields together; a separator such as U+0001 keeps
    different settings from giving the same key.
    """
    fields = [F.coalesce(text, F.lit(""))]
    fields += [F.lit(str(v)) for v in (model, n_paraphrases, temperature, seed)]
    return F.sha2(F.concat_ws(separator, *fields), 256)
