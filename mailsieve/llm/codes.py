"""Vector code compression: product quantisation by integer k-means, assigned through memoised grid cells.

Components become integers ``floor(scale * x)`` and a vector is cut into equal
consecutive parts; each part position has its own codebook. Finding the
nearest entry of a part is the hot loop. The part's coarse grid cell (every
component divided by ``step``, rounded down) names a box that holds it; for
that box the smallest and the largest squared distance to every entry are
bounded in closed form. An entry whose smallest distance over the box is
larger than some entry's largest distance can be nearest to no point of the
box, so only the others are kept, and the list is memoised under the cell's
hash for every later part in the same cell. Only the kept entries are
evaluated exactly (integer arithmetic, ties to the lower index), so the result
is that of a full scan.

The rounds are Spark jobs: every task assigns its rows and adds up, per part
position, entry and component, the sums and counts of its own rows; Spark adds
the task sums up by key (map-side first, so a hot entry is a few rows a task),
and the driver takes the few thousand totals and makes the next codebook, whose
size is bounded by ``entries`` × dimension. A codebook travels to the tasks
with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.llm.frames import put_back, set_apart, slices, with_small

#: Fixed by the contract: parts, entries, rounds and the integer scale.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Width of a grid cell in integer units (1/16 of a unit of the original scale), and cells memoised a task.
STEP, MEMO = 64, 1 << 16
_SAFE = 1 << 62


def finite(vector: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as longs (a float times a power of two is exact in double)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


class Cells:
    """Nearest entries of parts through memoised grid cells, for one codebook."""

    def __init__(self, book: np.ndarray, step: int = STEP, memo: int = MEMO):
        self.book, self.step, self.memo = book, step, memo
        self.parts, self.entries, self.width = book.shape
        self.found: list[dict[bytes, np.ndarray]] = [{} for _ in range(self.parts)]
        self.looked = self.computed = 0

    def _kept(self, j: int, cells: np.ndarray) -> list[np.ndarray]:
        """Per cell, the entries that some point of its box may have as nearest, ascending."""
        book = self.book[j].astype(np.float64)  # bounds only choose; exact distances decide
        lo = cells.astype(np.float64) * self.step
        hi = lo + (self.step - 1)
        out = []
        for at in range(0, len(cells), 128):
            a, b = lo[at:at + 128, None, :], hi[at:at + 128, None, :]
            gap = np.maximum(np.maximum(a - book, book - b), 0.0)
            near = (gap * gap).sum(-1)
            far = np.maximum((book - a) ** 2, (book - b) ** 2).sum(-1)
            # Rounding of doubles may only add entries: compare with a margin.
            limit = far.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-6
            out.extend(np.flatnonzero(row) for row in near <= limit)
        return out

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and exact squared distance of every part of ``x`` (n, parts, width)."""
        n = len(x)
        codes = np.zeros((n, self.parts), np.int64)
        dist = np.zeros((n, self.parts), object if self._wide(x) else np.int64)
        for j in range(self.parts):
            xj = x[:, j, :]
            cells = np.floor_divide(xj, self.step)
            keys = [c.tobytes() for c in cells]
            memo = self.found[j]
            if len(memo) > self.memo:
                memo.clear()
            missing = sorted({k for k in keys if k not in memo})
            if missing:
                where = {k: i for i, k in enumerate(keys)}
                for k, kept in zip(missing, self._kept(j, cells[[where[k] for k in missing]]), strict=True):
                    memo[k] = kept
                self.computed += len(missing)
            self.looked += n
            book = self.book[j].astype(dist.dtype)
            lists = [memo[k] for k in keys]
            if dist.dtype == object:
                self._exact_wide(xj, book, lists, codes[:, j], dist[:, j])
            else:
                self._exact(xj, book, lists, codes[:, j], dist[:, j])
        return codes, dist

    @staticmethod
    def _exact(x: np.ndarray, book: np.ndarray, lists: list[np.ndarray], codes: np.ndarray, dist: np.ndarray, rows: int = 256) -> None:
        """Exact distances to each part's kept entries, many parts at once: lists padded at their end."""
        for at in range(0, len(x), rows):
            part = lists[at:at + rows]
            width = max(len(c) for c in part)
            cand = np.full((len(part), width), -1, np.int64)
            for r, c in enumerate(part):
                cand[r, :len(c)] = c
            d = ((x[at:at + rows, None, :] - book[np.maximum(cand, 0)]) ** 2).sum(-1)
            d[cand < 0] = np.iinfo(np.int64).max
            best = np.argmin(d, axis=1)  # lists ascend, so the first of equal distances is the lower index
            codes[at:at + rows] = cand[np.arange(len(part)), best]
            dist[at:at + rows] = d[np.arange(len(part)), best]

    @staticmethod
    def _exact_wide(x: np.ndarray, book: np.ndarray, lists: list[np.ndarray], codes: np.ndarray, dist: np.ndarray) -> None:
        """The same with Python integers, one part at a time, for values beyond 63 bits."""
        for r, kept in enumerate(lists):
            d = ((x[r].astype(object)[None, :] - book[kept]) ** 2).sum(-1)
            best = int(np.argmin(d))
            codes[r], dist[r] = kept[best], d[best]

    def _wide(self, x: np.ndarray) -> bool:
        """Whether squared distances summed over a part might not fit in 63 bits."""
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(self.book).max(initial=0)))
        return (2 * top + 1) ** 2 * max(self.width, 1) >= _SAFE


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64)
    return flat.reshape(len(column), parts, -1)


def _totals(book: np.ndarray, step: int):
    """Per task: sums and counts of the rows assigned to every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(book, step)
        parts, entries, width = book.shape
        sums = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        for b in slices(batches, 2_000):
            x = _matrix(b.column(0), parts)
            codes, _ = cells.assign(x)
            for j in range(parts):
                part = np.zeros((entries, width), object if cells._wide(x) else np.int64)
                np.add.at(part, codes[:, j], x[:, j, :].astype(part.dtype))
                sums[j] += part
                counts[j] += np.bincount(codes[:, j], minlength=entries)
        j, k = np.nonzero(counts)
        if len(j):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[j, k]),
                    pa.array([[Decimal(int(v)) for v in sums[a, c]] for a, c in zip(j, k, strict=True)], pa.list_(pa.decimal128(38, 0))),
                ],
                ["part", "entry", "count", "sums"],
            )

    return run


def _codes(book: np.ndarray, step: int, keep: list[str]):
    """Per row: the code as hex and the final squared error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(book, step)
        for b in slices(batches, 2_000):
            codes, dist = cells.assign(_matrix(b.column("__q"), book.shape[0]))
            code = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            error = [int(sum(int(v) for v in row)) for row in dist]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"]
            )

    return run


def prepared(rows: DataFrame, vector: str, order: str) -> tuple[DataFrame, int]:
    """Kept rows with ``__q``, the integer vector, and its dimension.

    The dimension is that of the first vector in ``order``; vectors of any other
    length are left out with those that are null, empty or not finite.
    """
    kept = rows.where(finite(F.col(vector))).withColumn("__q", integers(F.col(vector)))
    first = kept.orderBy(F.col(order).asc_nulls_last(), "__q").select(F.size("__q")).head()
    width = first[0] if first else 0
    return kept.where(F.size("__q") == width), width


def fit(kept: DataFrame, order: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, step: int = STEP) -> np.ndarray:
    """The codebooks (parts, entries, width) after ``rounds`` rounds, from rows with ``__q``.

    Entry k of a part position starts as that part of the row with the k-th
    smallest ``order`` (ties by the vector; nulls last), so there are fewer
    entries when there are fewer rows. A round assigns every part and replaces
    each used entry by the componentwise floor of its parts' mean; unused ones stay.
    """
    seed = kept.orderBy(F.col(order).asc_nulls_last(), "__q").select("__q").limit(entries).collect()
    if not seed:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(seed[0][0])
    if width % parts:
        raise ValueError(f"a dimension of {width} has no {parts} equal parts")
    book = np.array([r[0] for r in seed], np.int64).reshape(len(seed), parts, width // parts).transpose(1, 0, 2).copy()
    narrow = kept.select("__q")
    for _ in range(rounds):
        totals = narrow.mapInArrow(_totals(book, step), "part int, entry int, count long, sums array<decimal(38,0)>")
        summed = (
            totals.select("part", "entry", "count", F.posexplode("sums").alias("pos", "s"))
            .groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("count").alias("count"))
            .collect()
        )
        new = book.astype(object)
        for r in summed:
            new[r.part, r.entry, r.pos] = int(r.s) // int(r["count"])
        book = np.array(new.tolist(), dtype=np.int64 if _fits(new) else object)
    return book


def _fits(book: np.ndarray) -> bool:
    return all(-(1 << 62) < int(v) < (1 << 62) for v in book.ravel())


def encode(kept: DataFrame, book: np.ndarray, keep: list[str], step: int = STEP) -> DataFrame:
    """``keep`` columns, ``code`` (two lowercase hex digits an entry, in part order) and ``error``
    (squared distances to the chosen entries, summed over parts)."""
    schema = kept.select(*keep).schema.add("code", "string").add("error", "long")
    return kept.select(*keep, "__q").mapInArrow(_codes(book, step, keep), schema)


def digest(book: np.ndarray) -> str:
    """sha256 of every component as a decimal integer, by part, entry, place; ``,``-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in book.ravel()).encode()).hexdigest()


def compress(
    rows: DataFrame, vector: str = "embedding", order: str = "vec_id", group: str = "label", step: int = STEP,
) -> tuple[DataFrame, np.ndarray]:
    """All columns of the kept rows with code, error and group_error, and the final codebooks.

    Rows whose vector is null, empty, holds a null or non-finite component, or
    is of another length than the first kept vector are left out; all others
    stay one for one, repeated rows included. ``group_error`` is the sum of
    ``error`` over rows of equal ``group`` (nulls together), taken from a
    per-group aggregate joined back, so a hot group is summed map-side first.
    An empty table gives no rows and empty codebooks. Columns of any names are
    carried; result columns win.
    """
    base, names = set_apart(rows, "code", "error", "group_error")
    kept, _ = prepared(base, names[vector], names[order])
    book = fit(kept, names[order], step=step)
    coded = encode(kept, book, list(names.values()), step)
    g = F.col(names[group]) if group in names else F.lit(None)
    coded = coded.withColumn("__g", g)
    sums = coded.groupBy("__g").agg(F.sum("error").alias("group_error")).withColumnRenamed("__g", "__h")
    joined = with_small(coded, sums, coded["__g"].eqNullSafe(sums["__h"]))
    return joined.select(*put_back(names), "code", "error", "group_error"), book
