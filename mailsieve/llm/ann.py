"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, taken from the centre, is brought to unit length, padded with zeros
and rotated at random. Only the signs are kept, with two scalars: its length,
and how well the signs point in its direction. From the packed signs the inner
product with a rotated query is estimated without bias, and with a bound on the
error. In every block of rows the k smallest upper bounds of a query give a
limit, and only rows whose lower bound is within it are measured exactly.

The query set meets all rows block by block; queries come in blocks as well, so
a task holds a bounded part of both. Every row is indexed; the sample gives only
the centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mailsieve.llm.frames import written
from mailsieve.llm.vectors import block, matrix, usable


@dataclass(frozen=True)
class CodeSettings:
    """``bits_per_dimension`` pads the code, ``bound`` is the error bound in standard deviations,
    ``sample_rows`` bounds the rows that give the centre (in expectation)."""

    bits_per_dimension: int = 4
    bound: float = 1.9
    sample_rows: int = 10_000
    block_rows: int = 8_192
    block_queries: int = 1_024
    seed: int = 42


def rotation(dimensions: int, s: CodeSettings) -> np.ndarray:
    """A random matrix with orthonormal columns, from the dimensions to a multiple of 64 bits."""
    bits = -(-dimensions * s.bits_per_dimension // 64) * 64
    gauss = np.random.default_rng(s.seed + dimensions).standard_normal((bits, dimensions))
    return np.linalg.qr(gauss)[0]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, distance to the centre, inner product of the signs with the direction)."""
    around = vectors - centre
    length = np.linalg.norm(around, axis=1)
    direction = around / np.where(length > 0, length, 1)[:, None] @ turn.T
    signs = direction >= 0
    point = np.abs(direction).sum(axis=1) / np.sqrt(turn.shape[0])
    return np.packbits(signs, axis=1), length, np.maximum(point, 1e-9)


def estimate(codes: np.ndarray, length: np.ndarray, point: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, its error bound) of every query to every coded row."""
    bits = turn.shape[0]
    around = queries - centre
    norm = np.linalg.norm(around, axis=1)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    inner = (around @ turn.T).astype(np.float32) @ signs.T / (np.sqrt(bits) * point)
    spread = np.sqrt(np.maximum(1 - point**2, 0)) / point * bound / np.sqrt(max(bits - 1, 1))
    squared = length**2 + (norm**2)[:, None] - 2 * length * inner
    return squared, 2 * length * norm[:, None] * spread


def nearest(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10,
    settings: CodeSettings = CodeSettings(),
) -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest rows by Euclidean distance, nearest first.

    Ties go to the smaller key. A query is not its own neighbour, though a
    second row with its key may be. Vectors that are null, empty, zero or not
    finite take no part, nor do rows without a key; vectors of different length
    are not compared. Fewer than k candidates are all returned.
    """
    s, spark = settings, vectors.sparkSession
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"),
        F.size(vector).alias("size"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = written(rows, "vectors")
    sizes = {r["size"]: r for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).collect()}
    rate = s.sample_rows / max(sum(r["n"] for r in sizes.values()), 1)
    chosen = F.pmod(F.xxhash64("row", F.lit(s.seed)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    sample = rows.where(chosen).select("size", F.posexplode("vector")).groupBy("size", "pos").agg(F.avg("col").alias("mean")).collect()
    centres = {n: np.zeros(n) for n in sizes}
    for r in sample:
        centres[r["size"]][r["pos"]] = r["mean"]
    model = spark.sparkContext.broadcast({n: (c, rotation(n, s)) for n, c in centres.items()})

    most = max((r["n"] for r in sizes.values()), default=1)
    row_blocks = max(1, -(-most // s.block_rows))
    query_blocks = max(1, -(-max((r["asked"] for r in sizes.values()), default=1) // s.block_queries))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = rows.withColumn("rb", block(F.col("row"), row_blocks)).withColumn("qb", every(query_blocks))
    # Columns of their own: both sides come from one table.
    right = rows.where("asks").select(
        F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("vector").alias("asked"), F.col("size").alias("asked_size"),
        block(F.col("row"), query_blocks).alias("query_block"), every(row_blocks).alias("row_block"),
    )

    def search(near: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "query_id": [], "group": [], "id": [], "score": []})
        if not len(near) or not len(asking):
            return empty
        centre, turn = model.value[int(near["size"].iloc[0])]
        x, q = matrix(near["vector"]), matrix(asking["asked"])
        codes, length, point = encode(x, centre, turn)
        squared, error = estimate(codes, length, point, q, centre, turn, s.bound)
        own = asking["query"].to_numpy()[:, None] == near["row"].to_numpy()
        upper = np.where(own, np.inf, squared + error)
        limit = np.partition(upper, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        parts, ids = [], near["id"].to_numpy()
        for i in range(len(q)):
            at = np.flatnonzero((squared[i] - error[i] <= limit[i]) & ~own[i])
            exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            parts.append((np.full(len(best), i), ids[at[best]], exact[best]))
        i, found, scores = (np.concatenate(p) for p in zip(*parts, strict=True))
        group = int(near["rb"].iloc[0]) // 256
        return pd.DataFrame({"query": asking["query"].to_numpy()[i], "query_id": asking["query_id"].to_numpy()[i], "group": group, "id": found, "score": scores})

    fields = "query long, query_id long, group int, id long, score double"
    found = left.groupBy("size", "rb", "qb").cogroup(right.groupBy("asked_size", "row_block", "query_block")).applyInPandas(search, fields)
    order = [F.col("score"), F.col("id")]
    # k rows a block: first the best of 256 blocks, then the best of these.
    some = W.partitionBy("query", "group").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    last = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
