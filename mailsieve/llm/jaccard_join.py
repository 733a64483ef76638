"""Jaccard join on word n-grams by chosen paths.

Every set is embedded by min-hashes: two sets agree at a place with probability
of their Jaccard similarity. A run starts from a root and samples places, 1 /
similarity of them on average; sets with the same value at a sampled place go
down the same path. Paths with many sets are split again on places sampled for
that path, those with few are compared one by one. A pair at the similarity
stays together with a probability that is known for every depth, and runs are
repeated until the target recall is reached.

Sets that are equal are one set with many copies from the start. A pair is
judged only in the first leaf that both sets share, so sums over leaves count
it once; what leaves a task is a row a set, never a pair. Candidates by
agreement of the min-hashes are verified on the whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from mailsieve.llm.frames import mix, put_back, set_apart, with_small, word_hashes, written
from mailsieve.llm.graph import components

_RUN_BITS, _AT_ONCE = 56, 1 << 21


@dataclass(frozen=True)
class JoinSettings:
    """``leaf`` is the size up to which sets are compared directly, ``depth`` the most splits; a leaf
    that is still larger is compared block by block, so none is left out. Where only classes are asked
    for, about ``hubs`` rows of such a leaf meet all its blocks before the others do."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.99
    places: int = 128
    leaf: int = 384
    depth: int = 4
    seed: int = 42
    hubs: int = 32

    @property
    def runs(self) -> int:
        """A pair at the similarity shares on average one child a node; it meets at depth d with
        probability q(d) = 1 - exp(-q(d - 1)), q(0) = 1."""
        q = 1.0
        for _ in range(self.depth):
            q = 1 - math.exp(-q)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - q))

    @property
    def agreement(self) -> int:
        """Agreeing places that a pair at the similarity reaches but for about 1 in 3,000."""
        spread = math.sqrt(self.places * self.similarity * (1 - self.similarity))
        return math.floor(self.places * self.similarity - 3.4 * spread)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of every text's word n-grams.

    A text of fewer words is one n-gram of all its words; one without words has
    none. A few megabytes of text are hashed at a time.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _AT_ONCE:
            yield from _shingle_group(group, words)
            group, size = [], 0
    yield from _shingle_group(group, words)


def _shingle_group(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, counts = word_hashes(texts, lower=False)
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * factor + hashes[k : k + len(rolled)]
    rolled, at = mix(rolled), 0
    for n in counts:
        if n >= words:
            yield np.unique(rolled[at : at + n - words + 1])
        elif n:
            short = np.uint64(n)
            for h in hashes[at : at + n]:
                short = mix(np.array([short]) * factor + h)[0]
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        at += n


def _min_hashes(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(best, (low[at : at + 4096, None] * a + b).min(axis=0), out=best)
    return best


def _chosen(path: np.ndarray, s: JoinSettings) -> np.ndarray:
    """Which places each path samples: a matrix of paths by places."""
    dice = mix(path[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(1, s.places + 1, dtype=np.uint64))
    return dice < np.uint64(int((1 << 64) / (s.similarity * s.places)))


def _child(path: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The path's run stays in its leading bits."""
    mixed = mix(mix(path) + (place.astype(np.uint64) << np.uint64(32)) + value.astype(np.uint64))
    return (path >> np.uint64(_RUN_BITS) << np.uint64(_RUN_BITS)) | (mixed >> np.uint64(64 - _RUN_BITS))


def _sign(docs: DataFrame, key: str, text: str, s: JoinSettings) -> DataFrame:
    """(key, set_id, marks, paths): marks are the last 8 bits of the min-hashes, paths the first of every run."""
    random = np.random.default_rng(s.seed)
    a = random.integers(0, 1 << 31, s.places, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = random.integers(0, 1 << 32, s.places, np.uint64).astype(np.uint32)
    roots = (np.arange(s.runs, dtype=np.uint64) << np.uint64(_RUN_BITS)) | np.uint64(s.seed & 0xFFFF)
    run, place = np.nonzero(_chosen(roots, s))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, marks, paths = [], [], []
            texts = [b"" if t is None else t.encode() for t in frame["text"]]
            for found in shingle_sets(texts, s.words):
                if not len(found):
                    ids.append(None), marks.append(None), paths.append(None)
                    continue
                values = _min_hashes(found, a, b)
                ids.append(hashlib.md5(found.tobytes()).digest())
                marks.append(values.astype(np.uint8).tobytes())
                paths.append(_child(roots[run], place, values[place]).view(np.int64))
            yield pd.DataFrame({"key": frame["key"], "set_id": ids, "marks": marks, "paths": paths})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(sign, f"key {kind}, set_id binary, marks binary, paths array<long>")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of paths with more than one set, with the path's size."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("path", "_path")
    return rows.join(sizes, F.col("path") == F.col("_path")).drop("_path")


def _leaves(sets: DataFrame, s: JoinSettings) -> DataFrame:
    """(path, set_id, size): the leaves of all runs that hold two sets or more."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            paths = frame["path"].to_numpy().astype(np.int64).view(np.uint64)
            marks = np.frombuffer(b"".join(frame["marks"]), np.uint8).reshape(len(frame), -1)
            row, place = np.nonzero(_chosen(paths, s))
            children = _child(paths[row], place, marks[row, place])
            yield pd.DataFrame({"path": children.view(np.int64), "set_id": frame["set_id"].to_numpy()[row]})

    active = sets.select(F.explode("paths").alias("path"), "set_id").distinct()
    active, done = written(_sized(active), "paths"), []
    for _ in range(s.depth - 1):
        large = active.where(F.col("size") > s.leaf)
        if large.isEmpty():
            break
        done.append(active.where(F.col("size") <= s.leaf))
        marked = large.join(sets.select("set_id", "marks"), "set_id").select("path", "set_id", "marks")
        active = written(_sized(marked.mapInPandas(split, "path long, set_id binary").distinct()), "paths")
    for more in done:
        active = active.unionByName(more)
    return active


def _tiles(leaves: DataFrame, s: JoinSettings) -> DataFrame:
    """Adds (tile, side): leaves above the limit are dealt into blocks, and every two blocks meet in one tile.

    Side 2 is compared with all, 0 and 1 only with each other.
    """
    blocks = F.ceil(F.col("size") / s.leaf).cast("int")
    block = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    other = F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == low, 0).otherwise(1)
    return leaves.withColumn("block", block).withColumn("other", other).withColumn("tile", low * 100_000 + high).withColumn("side", side).drop("block", "other")


def _first_tiles(leaves: DataFrame, s: JoinSettings) -> DataFrame:
    """As ``_tiles``, each row once: a leaf's blocks are compared within themselves, and every block with
    the same few rows of the leaf (chosen by hash, about ``hubs``), which hang the blocks together."""
    blocks = F.ceil(F.col("size") / s.leaf).cast("int")
    block = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    own = leaves.withColumn("tile", block).withColumn("side", F.lit(2))
    chosen = F.pmod(F.xxhash64("set_id", F.lit(s.seed)), F.ceil(F.col("size") / s.hubs)) == 0
    hubs = leaves.where(F.col("size") > s.leaf).where(chosen).withColumn("_own", block)
    hubs = hubs.withColumn("tile", F.explode(F.sequence(F.lit(0), blocks - 1))).where(F.col("tile") != F.col("_own"))
    return own.unionByName(hubs.drop("_own").withColumn("side", F.lit(0)))


def _other_tiles(leaves: DataFrame, roots: DataFrame, s: JoinSettings) -> DataFrame:
    """As ``_tiles``, for what the first tiles left: all pairs of a leaf but those within its largest class.

    Rows outside of that class, ``_minor``, are dealt into blocks of their own, which meet each other
    and every block of the class. A leaf that is one class has none and is done.
    """
    large = leaves.where(F.col("size") > s.leaf).join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    large = written(large.withColumn("root", F.coalesce("root", "set_id")), "rooted")
    counts = large.groupBy("path", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("path").agg(F.max_by("root", F.struct("n", "root")).alias("_main"), F.max("n").alias("_n"), F.sum("n").alias("_all"))
    main = main.where("_n < _all").select(F.col("path").alias("_path"), "_main", "_n", (F.col("_all") - F.col("_n")).alias("_few"))
    open_ = with_small(large, main, F.col("path") == F.col("_path"), "inner").withColumn("_minor", F.col("root") != F.col("_main"))
    few, many = (F.ceil(F.col(c) / s.leaf).cast("int") for c in ("_few", "_n"))
    block = F.pmod(F.xxhash64("set_id"), F.when(F.col("_minor"), few).otherwise(many)).cast("int")
    # Blocks of minor rows are 0 .. few - 1, those of the class follow.
    placed = open_.withColumn("_block", F.when(F.col("_minor"), block).otherwise(few + block))
    others = F.when(F.col("_minor"), F.sequence(F.lit(0), few + many - 1)).otherwise(F.sequence(F.lit(0), few - 1))
    placed = placed.withColumn("_other", F.explode(others))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    side = F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") == low, 0).otherwise(1)
    return placed.select(*leaves.columns, (low * 100_000 + high).alias("tile"), side.alias("side"))


def _groups(frames: Iterator[pd.DataFrame], at_once: int = 2_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows as frames of whole tiles, with the bounds of the tiles; a tile itself is bounded."""
    rest: pd.DataFrame | None = None

    def cut(frame: pd.DataFrame) -> np.ndarray:
        p, t = frame["path"].to_numpy(), frame["tile"].to_numpy()
        return np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])]))

    for frame in frames:
        rest = frame if rest is None or not len(rest) else pd.concat([rest, frame], ignore_index=True)
        if len(rest) < at_once:
            continue
        begins = cut(rest)
        if len(begins) > 1:
            whole = rest.iloc[: begins[-1]]
            rest = rest.iloc[begins[-1] :].reset_index(drop=True)
            yield whole, begins
    if rest is not None and len(rest):
        yield rest, np.append(cut(rest), len(rest))


def _candidates(marks: np.ndarray, side: np.ndarray, leaves: list[np.ndarray], here: int, s: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a tile that agree at enough places and share no earlier leaf."""
    left, right = [], []
    for i in range(len(marks) - 1):
        agree = np.count_nonzero(marks[i + 1 :] == marks[i], axis=1) >= s.agreement
        meet = (side[i + 1 :] != side[i]) | (side[i] == 2)
        j = np.flatnonzero(agree & meet) + i + 1
        left.append(np.full(len(j), i)), right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return i, j
    used, position = np.unique(np.concatenate([i, j])), np.zeros(len(marks), np.int64)
    position[used] = np.arange(len(used))
    earlier = [leaves[u][leaves[u].view(np.uint64) < np.uint64(here)] for u in used]
    values, column = np.unique(np.concatenate(earlier), return_inverse=True)
    if not len(values):
        return i, j
    member = np.zeros((len(used), len(values)), np.float32)
    member[np.repeat(np.arange(len(used)), [len(e) for e in earlier]), column] = 1
    new = (member @ member.T)[position[i], position[j]] == 0
    return i[new], j[new]


def _with_leaves(frame: pd.DataFrame, begins: np.ndarray, s: JoinSettings):
    """(first row, last row, i, j) of every tile in a frame that has candidates."""
    path, side = frame["path"].to_numpy().astype(np.int64), frame["side"].to_numpy()
    marks, leaves = frame["marks"].to_numpy(), frame["leaves"].to_numpy()
    for begin, end in zip(begins[:-1], begins[1:], strict=True):
        if end - begin < 2:
            continue
        own = np.frombuffer(b"".join(marks[begin:end]), np.uint8).reshape(end - begin, -1)
        lists = [np.asarray(x, np.int64) for x in leaves[begin:end]]
        i, j = _candidates(own, side[begin:end], lists, int(path[begin : begin + 1].view(np.uint64)[0]), s)
        if len(i):
            yield begin, end, i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of every row's component within a tile."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low), np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings(), links: bool = True) -> DataFrame:
    """(key, class_id, n_links) for every row; with ``links`` false ``n_links`` is null.

    ``n_links`` counts the other rows whose sets have at least the similarity,
    equal ones included; ``class_id`` is the smallest key reachable by links.
    Rows without words (null or empty text) link with nothing and are their own
    class. Null keys take part; a class of null keys alone has a null id.

    Counting links takes every pair of a dense leaf. Classes do not: rows that
    some links hang together already need no others among them, so the rows
    that move grow with a group's size, not with its square. The classes are
    the same.
    """
    s = settings
    signed = written(_sign(docs, key, text, s), "signatures")
    sets = signed.where("set_id is not null").groupBy("set_id").agg(
        F.count("*").alias("copies"), F.min("key").alias("least"), F.first("marks").alias("marks"), F.first("paths").alias("paths")
    )
    sets = written(sets, "sets")
    leaves = written(_leaves(sets, s), "leaves")
    # Sets meet in few leaves; their list is as long as runs and branching allow.
    met = sets.select("set_id", "copies", "least", "marks").join(
        leaves.groupBy("set_id").agg(F.collect_list("path").alias("leaves")), "set_id"
    )
    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of every tile that are in a candidate pair there."""
        for frame, begins in _groups(frames):
            keep = np.zeros(len(frame), bool)
            for begin, _, i, j in _with_leaves(frame, begins, s):
                keep[begin + i] = keep[begin + j] = True
            yield frame[keep]

    fields = "path long, tile int, side int, set_id binary, copies long, least {kind}, marks binary, leaves array<long>".format(kind=sets.schema["least"].dataType.simpleString())
    columns = [f.strip().split()[0] for f in fields.split(",")]
    def shingle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = list(shingle_sets([t.encode() for t in frame["text"]], s.words))
            yield pd.DataFrame({"set_id": [hashlib.md5(x.tobytes()).digest() for x in found], "shingles": [x.tobytes() for x in found]})

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a linked set and tile: how many rows it links with, and the smallest set it hangs together with."""
        for frame, begins in _groups(frames, 512):
            ids, copies, shingles = frame["set_id"].to_numpy(), frame["copies"].to_numpy(), frame["shingles"].to_numpy()
            for begin, end, i, j in _with_leaves(frame, begins, s):
                own = [np.frombuffer(x, np.uint64) for x in shingles[begin:end]]
                link = _similar(own, i, j, s.similarity)
                i, j = i[link], j[link]
                if not len(i):
                    continue
                n, weight = end - begin, copies[begin:end]
                links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
                root, at = _roots(n, i, j), np.unique(np.concatenate([i, j]))
                yield pd.DataFrame({"set_id": ids[begin + at], "links": links[at].astype(np.int64), "root": ids[begin + root[at]]})

    def linked_in(tiles: DataFrame) -> DataFrame:
        """(set_id, links, root) of the tiles' linked sets."""
        by_tile = tiles.join(met, "set_id").repartition("path", "tile").sortWithinPartitions("path", "tile", "set_id")
        candidates = written(by_tile.select(*columns).mapInPandas(near, fields), "candidates")
        needed = candidates.select("set_id", "least").distinct()
        # A set's texts come from the rows with its smallest key; equal keys may bring others, which the join leaves out.
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
        texts = with_small(rows, needed.select("least").distinct(), F.col("key").eqNullSafe(F.col("least")), "left_semi")
        whole = texts.select("text").mapInPandas(shingle, "set_id binary, shingles binary").dropDuplicates(["set_id"])
        with_sets = candidates.join(whole, "set_id").repartition("path", "tile").sortWithinPartitions("path", "tile", "set_id")
        return written(with_sets.select(*columns, "shingles").mapInPandas(verify, "set_id binary, links long, root binary"), "linked")

    if links:
        linked = linked_in(_tiles(leaves, s))
    else:
        linked = linked_in(_first_tiles(leaves, s))
        if not leaves.where(F.col("size") > s.leaf).isEmpty():
            hung = components(linked.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
            linked = linked.unionByName(linked_in(written(_other_tiles(leaves, hung, s), "tiles")))
    found = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    grouped = sets.select("set_id", "copies", "least").join(found, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "set_id"))
    classes = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    # Sets that stand alone need no row.
    known = grouped.where("copies > 1 or links is not null").join(classes, "root").select(
        F.col("set_id").alias("_set"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = signed.select("key", "set_id").join(known, F.col("set_id") == F.col("_set"), "left")
    return rows.select(
        F.col("key").alias(key), F.when(F.col("_set").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("n_links", F.lit(0)) if links else F.lit(None)).cast("long").alias("n_links"),
    )


def _similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs reach the similarity, exactly: shared n-grams counted through blocks of an incidence matrix."""
    used = np.unique(np.concatenate([i, j]))
    position = np.zeros(len(sets), np.int64)
    position[used] = np.arange(len(used))
    sizes = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), sizes[used])
    shared = np.zeros((len(used), len(used)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column, width = row[by], column[by], 8192
    for begin in range(0, len(values), width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        block = np.zeros((len(used), min(width, len(values) - begin)), np.float32)
        block[row[lo:hi], column[lo:hi] - begin] = 1
        shared += block @ block.T
    common = shared[position[i], position[j]]
    return common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings()) -> DataFrame:
    """The documents with one row of each class: the one with the smallest key.

    A row is named by its key and the digest of its text, as one text that
    sorts by the key first, so rows that share a key but not a text are apart:
    each is linked by its own words, and unlike texts under one key all stay.
    Rows equal in key and text are one; one of them stays. Of a class, the row
    of the smallest key stays (of equal keys, the smaller digest). Rows with a
    null key all stay, since nothing tells them apart. Columns of any names are
    carried as they are.
    """
    base, names = set_apart(docs)
    own = F.col(names[key])
    words = F.coalesce(F.col(names[text]), F.lit(""))
    if isinstance(base.schema[names[key]].dataType, T.IntegralType):
        # A long shifted to be unsigned, in 20 digits: text order is number order.
        ordered = F.lpad((own.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    else:
        ordered = own.cast("string")
    keyed = base.withColumn("__ident", F.concat(ordered, F.lit("\x00"), F.sha2(words, 256)))
    found = written(join(keyed.select("__ident", F.col(names[text]).alias("__text")), "__ident", "__text", settings, links=False), "classes")
    winners = found.where(F.col("__ident") == F.col("class_id")).select(F.col("__ident").alias("__win")).distinct()
    named = keyed.where(own.isNotNull())
    stay = with_small(named, winners, F.col("__ident") == F.col("__win"), "left_semi").dropDuplicates(["__ident"])
    return stay.unionByName(keyed.where(own.isNull())).select(*put_back(names))
