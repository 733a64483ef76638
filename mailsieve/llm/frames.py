"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsieve.operators.lineage import scratch_path

#: A-Z to a-z and nothing else; white space is the six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: a lost executor costs a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, the empty text for null."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces: only a piece is ever held as Python objects.

    What earlier tasks have left in a reused worker, in cycles that wait for
    the collector, is let go first.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_AT_ONCE = 1 << 21


def _hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n" + bytes(8)
    joined = joined.lower() if lower else joined
    buffer = np.frombuffer(joined, np.uint8)
    space = _SPACE[buffer[:-8]]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    eight = np.ndarray((len(buffer) - 7,), "<u8", joined, 0, (1,))
    length = ends - starts
    found = mix((eight[starts] & _MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) << np.uint64(56)))
    at, left = np.flatnonzero(length > 8), 8
    while len(at):
        more = eight[starts[at] + left] & _MASK[np.minimum(length[at] - left, 8)]
        found[at] = mix(found[at] * np.uint64(0x9E3779B97F4A7C15) + more)
        left += 8
        at = at[length[at] > left]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return found, np.diff(np.searchsorted(starts, begins))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and how many words each text has.

    Words are runs without ASCII white space, by default with A-Z in lower case. Eight
    bytes of every word are hashed at once; texts are taken together up to
    about two million bytes, so memory does not grow with the batch.
    """
    parts, counts, group, size = [], [], [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _AT_ONCE:
            h, n = _hashes(group, lower)
            parts.append(h), counts.append(n)
            group, size = [], 0
    if group:
        h, n = _hashes(group, lower)
        parts.append(h), counts.append(n)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of ``values``, added up one text at a time."""
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def with_small(rows: DataFrame, table: DataFrame, on: Column, how: str = "left", limit: int = 8 << 20) -> DataFrame:
    """Join with a table that is usually small: broadcast if its measured bytes are at most
    ``limit``, else a shuffled join, whose hot keys adaptive execution splits."""
    width = F.sum(F.octet_length(F.to_json(F.struct(*table.columns))) + 64)
    if (table.agg(width).head()[0] or 0) <= limit:
        return rows.join(F.broadcast(table), on, how)
    return rows.join(table, on, how)


def set_apart(df: DataFrame, *drop: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame under column names that no helper column has, and the new name of each column."""
    kept = [c for c in df.columns if c not in drop]
    names = {c: f"__{i}_{c}" for i, c in enumerate(kept)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def put_back(names: dict[str, str]) -> list[Column]:
    return [F.col(f"`{n}`").alias(c) for c, n in names.items()]
