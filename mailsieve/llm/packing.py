"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Every document becomes its token ids and one end id; one that is longer than
a sequence is cut into pieces of a sequence's length, of which only the first
may be shorter. Pieces are the items.

Round 0 runs best-fit decreasing in every partition: Spark sorts the items of
a partition by size, largest first, and a task streams them into its bins,
each into the fullest bin that still has room. A bin that can take no item
of the table any more (its free room is below the smallest item, a global
minimum measured before the round) is final and leaves at once. What is open at
the partition's end is underfull. Of it, best-fit decreasing leaves at most one
bin that is at most half full (two such would have been one). That small bin
goes up to the next round with the larger bins that it or another slot's small
bin may go into. Each further round groups the bins that came up from
``fan_in`` slots of the round before and packs them, whole, by best fit again,
until one slot is left.

Nothing that could be placed is left out. Two larger bins never share a
sequence, so only small bins look for one, at most ``fan_in`` of them in a
group and round. Bins of equal room are alike to them: of each room,
``fan_in`` bins for every round to come are as many as can ever be taken, and
bins with less room than the smallest small bin of the whole table fills can
take none. All others go up, and the result is that of carrying every open
bin. So what a slot sends is bounded by the number of rooms (half a capacity)
times these, however many documents there are, and nothing is ever gathered
whole in one task or the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from mailsieve.llm import bpe
from mailsieve.llm.frames import written

#: Length of a sequence and the id that ends every document (fixed by the contract).
CAPACITY, END_ID = 2048, 0
#: Slots that a group of the next round takes.
FAN_IN = 8
#: Rows of a slot in round 0: the work of one task, the same at every size.
SLOT_ROWS = 20_000

MEMBER = "struct<doc_id long, piece int, start long, length long, ids_crc32 long, offset long>"
BINS = f"final boolean, slot long, fill long, sequence_id long, members array<{MEMBER}>"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut.

    A null text is the empty text (one piece: the end id). A document of n ids
    and the end id is one piece if n + 1 <= ``capacity``; otherwise the first
    piece holds (n + 1) mod ``capacity`` ids, if that is not 0, and every other
    piece ``capacity``. Rows are kept one for one, repeated rows and equal ids
    included; ``ids_crc32`` is the unsigned crc32 of the piece's ids as
    little-endian unsigned 32-bit integers.
    """
    ids = bpe.encode(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), path)
    ended = ids.select("doc_id", F.concat("ids", F.lit(END_ID.to_bytes(4, "little"))).alias("ids"))
    total = (F.octet_length("ids") / 4).cast("long")
    first = F.pmod(total, F.lit(capacity))
    count = F.ceil(total / capacity).cast("long")
    cut = ended.select("doc_id", "ids", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.when((F.col("first") == 0) | (F.col("piece") == 0), F.col("piece") * capacity).otherwise(
        F.col("first") + (F.col("piece") - 1) * capacity
    )
    length = F.when((F.col("first") > 0) & (F.col("piece") == 0), F.col("first")).otherwise(F.lit(capacity).cast("long"))
    placed = cut.select("doc_id", "ids", F.col("piece").cast("int").alias("piece"), start.alias("start"), length.alias("length"))
    return placed.select(
        "doc_id", "piece", "start", "length",
        F.crc32(F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))).alias("ids_crc32"),
    )


class _Slots:
    """Bins by free room, and the bin of least room at least a size, in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.n)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, b: int) -> None:
        self.bins.setdefault(room, []).append(b)
        i = room + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> int | None:
        """A bin of the least free room >= size, or None; it leaves the structure."""
        i = size + self.n
        if not self.count[i]:
            while True:
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
                if i <= 1:
                    return None
            while i < self.n:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.n
        b = self.bins[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return b


class _Packer:
    """Best fit of items that come largest first; bins that can take nothing more leave at once."""

    def __init__(self, capacity: int, least: int, level: int, slot: int):
        self.capacity, self.least, self.level, self.slot = capacity, least, level, slot
        self.slots = _Slots(capacity)
        self.fill: list[int] = []
        self.members: list[list[tuple]] = []
        self.done: list[int] = []
        self.made = 0

    def put(self, size: int, members: list[tuple]) -> None:
        b = self.slots.take(size)
        if b is None:
            b = len(self.fill)
            self.fill.append(0), self.members.append([])
        self.fill[b] += size
        self.members[b].extend(members)
        room = self.capacity - self.fill[b]
        if room < self.least:
            self.done.append(b)
        else:
            self.slots.add(room, b)

    def sequence_id(self) -> int:
        if self.made >= 1 << 24 or self.slot >= 1 << 32 or self.level >= 1 << 7:
            raise OverflowError("more bins in a slot than sequence ids can name")
        self.made += 1
        return (self.level << 56) | (self.slot << 24) | (self.made - 1)

    def row(self, b: int, final: bool, slot: int) -> dict:
        members, at = [], 0
        for doc_id, piece, start, length, crc in self.members[b]:
            members.append({"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "offset": at})
            at += length
        self.members[b] = []
        return {"final": final, "slot": slot, "fill": self.fill[b], "sequence_id": self.sequence_id(), "members": members}

    def flush_done(self) -> list[dict]:
        out = [self.row(b, True, self.slot) for b in self.done]
        self.done = []
        return out

    def close(self, last: bool, carry: int) -> list[dict]:
        """Every open bin: final at the last round; else the small one and ``carry`` others of each room go up."""
        out = self.flush_done()
        open_bins = [b for b in range(len(self.fill)) if self.members[b]]
        up: set[int] = set()
        if not last:
            alike: Counter[int] = Counter()
            for b in open_bins:
                alike[self.fill[b]] += 1
                if 2 * self.fill[b] <= self.capacity or alike[self.fill[b]] <= carry:
                    up.add(b)
        return [*out, *[self.row(b, b not in up, self.slot) for b in open_bins]]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("final", pa.bool_()), ("slot", pa.int64()), ("fill", pa.int64()), ("sequence_id", pa.int64()),
    ("members", pa.list_(pa.struct([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("offset", pa.int64()),
    ]))),
])


def _first_round(capacity: int, least: int, carry: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        packer = _Packer(capacity, least, 0, slot)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            for doc_id, piece, start, length, crc in zip(*cols, strict=True):
                packer.put(length, [(doc_id, piece, start, length, crc)])
            out = packer.flush_done()
            if out:
                yield _batch(out)
        out = packer.close(last, carry)
        if out:
            yield _batch(out)

    return run


def _next_round(capacity: int, least: int, carry: int, last: bool, level: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        packer = _Packer(capacity, least, level, int(key[0]))
        # Largest first; ties by the first member, so that a rerun packs alike.
        order = sorted(
            range(len(frame)), key=lambda i: (-int(frame["fill"].iat[i]), _first(frame["members"].iat[i]))
        )
        for i in order:
            members = [(m["doc_id"], m["piece"], m["start"], m["length"], m["ids_crc32"]) for m in frame["members"].iat[i]]
            packer.put(int(frame["fill"].iat[i]), members)
        rows = packer.close(last, carry)
        # Typed columns: 64-bit ids must never pass through doubles.
        kinds = {"final": "bool", "slot": "int64", "fill": "int64", "sequence_id": "Int64", "members": "object"}
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=k) for c, k in kinds.items()})

    return run


def _first(members) -> tuple:
    m = members[0]
    return (m["doc_id"] is None, m["doc_id"] or 0, m["piece"], m["start"])


def pack(
    items: DataFrame, capacity: int = CAPACITY, carry: int = 0, fan_in: int = FAN_IN, slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Every piece once, with ``sequence_id`` and ``offset``: places in sequences of at most ``capacity``.

    ``items`` has doc_id, piece, start, length, ids_crc32 (other columns are
    not carried). The items are written once and dealt round robin into slots
    of about ``slot_rows`` rows for round 0. Offsets in a sequence run gapless
    from 0 in the order pieces were placed; sequence ids are unique numbers. An
    empty table gives no rows. Pieces longer than ``capacity`` are refused.
    ``carry`` sends up more bins of each room than can be of use, never fewer.
    Each round's bins are written to the shared folder, so a lost executor
    costs at most the round it was in.
    """
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = written(items.select(*fields), "pieces")
    total, least, longest = items.agg(F.count("*"), F.min("length"), F.max("length")).head()
    if not total:
        return items.select(*fields, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    if longest > capacity:
        raise ValueError(f"a piece of {longest} ids is longer than a sequence")
    slots = -(-total // slot_rows)
    ranked = items.repartition(slots).sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "start")
    depth, left = 0, slots
    while left > 1:
        depth, left = depth + 1, -(-left // fan_in)

    def carried(level: int) -> int:
        return max(carry, fan_in * (depth - level))

    level, rounds = 0, []
    bins = written(ranked.mapInArrow(_first_round(capacity, least, carried(0), slots == 1), BINS), "packed_0")
    while True:
        small = bins.where(f"not final and 2 * fill <= {capacity}").agg(F.min("fill")).head()[0]
        if small is None:
            rounds.append(bins)
            break
        goes_up = f"not final and (2 * fill <= {capacity} or {capacity} - fill >= {small})"
        rounds.append(bins.where(f"not ({goes_up})"))
        level += 1
        up = bins.where(goes_up)
        top = up.agg(F.max("slot")).head()[0]
        up = up.withColumn("slot", (F.col("slot") / fan_in).cast("long"))
        bins = written(
            up.groupBy("slot").applyInPandas(_next_round(capacity, small, carried(level), top // fan_in == 0, level), BINS), f"packed_{level}"
        )
    done = rounds[0]
    for r in rounds[1:]:
        done = done.unionByName(r)
    return done.select("sequence_id", F.explode("members").alias("m")).select(
        *[F.col(f"m.{c}").alias(c) for c in fields], "sequence_id", F.col("m.offset").alias("offset"),
    )


def sequences_lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing needs fewer sequences than the total length over the capacity."""
    return int(-(-int(lengths.sum()) // capacity))
