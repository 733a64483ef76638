"""Embedding near-dedup by counting collisions of one-dimensional projections.

Unit vectors are projected on many random lines. Two vectors at the wanted
cosine are close on most lines: on each, they fall into one window, centred on
the one that asks, with a known probability. The number of windows they share
is binomial, so the least number a pair must reach follows from the recall.
Pairs that reach it are verified by their cosine in double precision.

The first few lines also deal the work out. Their axes are cut into cells as
wide as such a pair is ever apart, but for one in a thousand, so only
neighbouring cells meet. Cells with many vectors are dealt into blocks. What
leaves a task is a row a vector, never a pair; equal vectors are one from the
start.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mailsieve.llm.frames import with_small, written
from mailsieve.llm.graph import components
from mailsieve.llm.vectors import matrix, usable

_BASE = 64


@dataclass(frozen=True)
class CollisionSettings:
    """``window`` is half a window's width, in standard deviations of a pair at the cosine."""

    cosine: float = 0.98
    lines: int = 48
    window: float = 1.0
    recall: float = 0.999
    block: int = 1_024
    most_axes: int = 3
    seed: int = 42

    @property
    def spread(self) -> float:
        """Standard deviation on a line of the difference of two unit vectors at the cosine."""
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def least(self) -> int:
        """The most collisions that a pair at the cosine reaches with the recall."""
        p, total = math.erf(self.window / math.sqrt(2)), 0.0
        for k in range(self.lines + 1):
            total += math.comb(self.lines, k) * p**k * (1 - p) ** (self.lines - k)
            if total > 1 - self.recall:
                return k
        return 0

    @property
    def cell(self) -> float:
        return 3.3 * self.spread


def lines(dimensions: int, s: CollisionSettings) -> np.ndarray:
    return np.random.default_rng(s.seed + dimensions).standard_normal((dimensions, s.lines))


def collisions(asking: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """How many windows, centred on the asking rows, hold each other row; line by line over sorted places."""
    count = np.zeros((len(asking), len(others)), np.int16)
    rank = np.empty(len(others), np.int32)
    for j in range(asking.shape[1]):
        order = np.argsort(others[:, j], kind="stable")
        rank[order] = np.arange(len(others), dtype=np.int32)
        line = others[order, j]
        low = np.searchsorted(line, asking[:, j] - half, "left").astype(np.int32)
        high = np.searchsorted(line, asking[:, j] + half, "right").astype(np.int32)
        count += (rank >= low[:, None]) & (rank < high[:, None])
    return count


def _cells(vectors: DataFrame, axes: int, s: CollisionSettings) -> DataFrame:
    """Adds the cell of every vector: its places on the first lines, as one number."""

    def run(frames):
        for frame in frames:
            cells = np.zeros(len(frame), np.int64)
            for n, part in frame.groupby("size"):
                x = matrix(part["vector"])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                place = np.clip(np.floor(x @ lines(int(n), s)[:, :axes] / s.cell) + _BASE // 2, 0, _BASE - 1).astype(np.int64)
                cells[frame.index.get_indexer(part.index)] = place @ (_BASE ** np.arange(axes))
            yield frame.assign(cell=cells)

    return vectors.mapInPandas(run, f"{_ddl(vectors)}, cell long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _tile(s: CollisionSettings):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "node"]).reset_index(drop=True)
        none = pd.DataFrame(columns=["node", "links", "root"], dtype=object)
        side = frame["side"].to_numpy()
        same = side[0] == 2
        a = np.arange(len(frame)) if same else np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        if not len(a) or not len(b) or (same and len(a) < 2):
            return none
        x = matrix(frame["vector"])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        on = x @ lines(x.shape[1], s)
        i, j = np.nonzero(collisions(on[a], on[b], s.window * s.spread) >= s.least)
        i, j = a[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        near = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 17):
            part = slice(at, at + (1 << 17))
            near[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) >= s.cosine
        i, j = i[near], j[near]
        if not len(i):
            return none
        n, copies = len(frame), frame["copies"].to_numpy()
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = np.arange(n)
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low), np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at, node = np.unique(np.concatenate([i, j])), frame["node"].to_numpy()
        return pd.DataFrame({"node": node[at], "links": links[at].astype(np.int64), "root": node[root[at]]})

    return run


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: CollisionSettings = CollisionSettings()
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Only vectors of one label that is not null, and of one length, are
    compared. Vectors that are null, empty, zero or not finite, and those
    without a label, link with nothing and are kept. ``n_links`` counts rows,
    copies included. ``component_id`` is the smallest key reachable; rows with
    that key are kept. Null keys take part; a component of null keys alone has
    a null id and is kept whole.
    """
    s = settings
    takes_part = usable(F.col(vector)) & F.col(label).isNotNull()
    node = F.md5(F.concat_ws(":", F.col(label).cast("string"), F.to_json(vector)))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"), F.when(takes_part, node).alias("node"))
    classes = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("key").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector")
    ).withColumn("size", F.size("vector"))
    classes = written(classes, "vectors")
    most = classes.groupBy("label", "size").count().agg(F.max("count")).head()[0] or 1
    # Each axis leaves about a quarter of the vectors in a cell.
    axes = min(s.most_axes, max(1, math.ceil(math.log(max(most / s.block, 1)) / math.log(4))))
    placed = written(_cells(classes, axes, s), "cells")

    at = ["label", "size", "cell"]
    sizes = placed.groupBy(*at).agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    steps = [sum(d * _BASE**k for k, d in enumerate(o)) for o in itertools.product((-1, 0, 1), repeat=axes)]
    ahead = F.explode(F.array(*[F.col("cell") + F.lit(x).cast("long") for x in sorted(steps) if x >= 0]))
    first = sizes.withColumnRenamed("blocks", "first_blocks").withColumn("other", ahead)
    second = sizes.select("label", "size", F.col("cell").alias("other"), F.col("blocks").alias("second_blocks"))
    meetings = written(first.join(second, ["label", "size", "other"]), "meetings")

    own = F.pmod(F.xxhash64("node"), F.col("own_blocks")).cast("int")
    fields = [*at, "other", "one", "two", "side", "node", "copies", "vector"]

    def range_(start, stop):
        return F.explode(F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>")))

    # The first cell of a meeting: each of its blocks meets every block of the second; within one cell, those from its own on.
    firsts = placed.join(meetings.withColumn("own_blocks", F.col("first_blocks")), at).withColumn("one", own)
    firsts = firsts.withColumn("two", range_(F.when(F.col("cell") == F.col("other"), F.col("one")).otherwise(F.lit(0)), F.col("second_blocks")))
    firsts = firsts.withColumn("side", F.when((F.col("cell") == F.col("other")) & (F.col("one") == F.col("two")), 2).otherwise(0))
    seconds = placed.withColumnRenamed("cell", "other").join(meetings.withColumn("own_blocks", F.col("second_blocks")), ["label", "size", "other"]).withColumn("two", own)
    seconds = seconds.withColumn("one", range_(F.lit(0), F.when(F.col("cell") == F.col("other"), F.col("two")).otherwise(F.col("first_blocks"))))
    tiles = firsts.select(*fields).unionByName(seconds.withColumn("side", F.lit(1)).select(*fields))
    linked = written(
        tiles.groupBy("label", "size", "cell", "other", "one", "two").applyInPandas(_tile(s), "node string, links long, root string"), "linked"
    )
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("_n"), "root")
    grouped = classes.select("node", "copies", "least").join(links, "node", "left").join(roots, F.col("node") == F.col("_n"), "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "node"))
    found = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        F.col("node").alias("_node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = with_small(rows.select("key", "node"), written(found, "components"), F.col("node") == F.col("_node"))
    component = F.when(F.col("_node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )
