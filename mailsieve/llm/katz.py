"""LM scoring: Katz backoff over words, with counts in tables partitioned by n-gram.

Documents are taken in chunks, a bounded number of characters of one input
partition. A chunk sends every distinct word and word pair once, as sorted
64-bit hashes with the training counts, to the shard that owns the hash. The
shard adds counts up over all chunks and answers each chunk in the order asked.
Counts of counts, a few numbers, give the Good-Turing discounts. Then

    p(w | v) = d c(v w) / c(v)      if the pair was seen in training
             = alpha(v) p(w)        if not; p(w) if v was not seen
    p(w)     = d c(w) scaled, or the mass kept for unknown words

where alpha(v) makes the probabilities after v sum to one exactly. Its sums
over the words seen after v are made where each pair is owned, by one of the
chunks that hold it, and added up in a second exchange by v. A frequent word is
one entry a chunk, so no key is hot, and no table is ever whole in one place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from mailsieve.llm.frames import mix, sums_by_text, texts_of, word_hashes, written

_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_LARGEST = 5
_FIELDS = "kind string, chunk long, shard int, keys binary, data binary"


@dataclass(frozen=True)
class KatzSettings:
    """``chunk_chars`` bounds what a task holds at once, ``shard_bytes`` the text that a shard's counts come from."""

    chunk_chars: int = 10 << 20
    shard_bytes: int = 12 << 20


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: equal leading bytes cost nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the one before, tokens a text): the words of every text and its end."""
    words, counts = word_hashes(texts)
    lengths = counts + 1
    last = np.cumsum(lengths) - 1
    token = np.empty(int(lengths.sum()), np.uint64)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner], token[last] = words, _END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[last - lengths + 1] = _BEGIN
    return token, before, lengths


def _pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(token))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[str], list[bool], list[bytes]]]:
    """(chunk, ids, held out, texts). The same input gives the same chunks on every evaluation."""
    base, number = 0, 0
    ids, held, texts, chars = [], [], [], 0
    for b in batches:
        if b.num_rows:
            base = b.column("part")[0].as_py() << 24
        for i, h, t in zip(b.column("key").to_pylist(), b.column("held").to_pylist(), texts_of(b.column("text")), strict=True):
            ids.append(i), held.append(h), texts.append(t)
            chars += len(t)
            if chars >= size:
                yield base + number, ids, held, texts
                ids, held, texts, chars, number = [], [], [], 0, number + 1
    if ids:
        yield base + number, ids, held, texts


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of every shard's keys, in the order of the keys."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if bounds[s] < bounds[s + 1]:
            yield s, order[bounds[s] : bounds[s + 1]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("kind", pa.string()), ("chunk", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


def _contexts(token: np.ndarray, before: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words with the begin, their training counts, place of each token, place of each token's predecessor)."""
    begins = before == _BEGIN
    words, place = np.unique(np.concatenate([token, [_BEGIN]]), return_inverse=True)
    place = place[:-1]
    counts = np.bincount(place[trained], minlength=len(words)).astype(np.uint32)
    begin_at = int(np.searchsorted(words, _BEGIN))
    counts[begin_at] = np.count_nonzero(begins & trained)
    previous = np.empty_like(place)
    previous[1:] = place[:-1]
    previous[begins] = begin_at
    return words, counts, place, previous


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0 to ``_LARGEST``, by Katz; 1 beyond. ``n``: counts of counts 1 ...

    Where counts of counts are missing or give no discount between 0 and 1,
    half an occurrence is taken off instead.
    """
    out, k = np.ones(_LARGEST + 1), _LARGEST
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common != 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class KatzNumbers:
    """All that is global: training tokens, distinct ones, discounts of words and of pairs."""

    tokens: int
    distinct: int
    word: np.ndarray
    pair: np.ndarray
    kept: float  # discounted count of all words

    @property
    def unknown(self) -> float:
        """Probability of an unknown word: what the discounts leave, or half a count if they leave less."""
        if not self.tokens:
            return 1.0
        return max(1 - self.kept / self.tokens, 0.5 / (self.tokens + 0.5 * (self.distinct + 1)))

    def unigram(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.full(len(count), 1.0)
        d = self.word[np.minimum(count, _LARGEST)]
        d[count > _LARGEST] = 1.0
        return np.where(count > 0, (1 - self.unknown) * d * count / self.kept, self.unknown)

    def discounted(self, count: np.ndarray) -> np.ndarray:
        d = self.pair[np.minimum(count, _LARGEST)]
        d[count > _LARGEST] = 1.0
        return d * count


def _numbers(stats: dict[str, np.ndarray]) -> KatzNumbers:
    word, pair = stats.get("u", np.zeros(8)), stats.get("b", np.zeros(8))
    d = discounts(word[:6])
    lost = sum((1 - d[r]) * r * word[r - 1] for r in range(1, _LARGEST + 1))
    return KatzNumbers(int(word[7]), int(word[6]), d, discounts(pair[:6]), float(word[7] - lost))


def _requests(docs: DataFrame, shards: int, s: KatzSettings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, held, texts in _chunks(batches, s.chunk_chars):
            token, before, lengths = _tokens(texts)
            trained = np.repeat(~np.array(held), lengths)
            words, counts, place, previous = _contexts(token, before, trained)
            needed = np.zeros(len(words), np.uint8)
            needed[previous[~trained]] = 1
            yield _batch([("u", chunk, k, _pack_sorted(words[at]), _pack(counts[at]) + needed[at].tobytes()) for k, at in _by_shard(words, shards)])
            pairs = _pairs(before, token)
            every, at = np.unique(pairs), np.sort(pairs[trained])
            counts = (np.searchsorted(at, every, "right") - np.searchsorted(at, every, "left")).astype(np.uint32)
            yield _batch([("b", chunk, k, _pack_sorted(every[at]), _pack(counts[at])) for k, at in _by_shard(every, shards)])

    return docs.mapInArrow(run, _FIELDS)


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals, answered to every chunk in its own order, and a row of counts of counts."""
    kind, shard = frame["kind"].iloc[0], int(frame["shard"].iloc[0])
    frame = frame.sort_values("chunk")
    keys = [_unpack_sorted(k) for k in frame["keys"]]
    sizes = [len(k) for k in keys]
    if kind == "u":
        needed = np.concatenate([np.frombuffer(d[-n:], np.uint8) for d, n in zip(frame["data"], sizes, strict=True)])
        counts = [_unpack(d[:-n], np.uint32) for d, n in zip(frame["data"], sizes, strict=True)]
    else:
        counts = [_unpack(d, np.uint32) for d in frame["data"]]
    counts = np.concatenate(counts)
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    # Totals of all chunks in 64 bits: a chunk's counts fit in 32, their sum may not.
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, place, counts.astype(np.uint64))
    if kind == "u":
        wanted = np.bincount(place, needed, len(every)) > 0
        flag = wanted[place] | (total[place] > _LARGEST)
    else:
        # A pair is owned by the first chunk that saw it in training.
        seen = np.flatnonzero(counts > 0)
        first = np.full(len(every), -1)
        first[place[seen[::-1]]] = seen[::-1]
        flag = first[place] == np.arange(len(place))
    rows, at = [], 0
    for chunk, n in zip(frame["chunk"], sizes, strict=True):
        part = slice(at, at + n)
        rows.append((kind, chunk, shard, _pack(total[place[part]]), np.packbits(flag[part]).tobytes()))
        at += n
    own = total[every != _BEGIN] if kind == "u" else total
    stats = np.array([*(np.count_nonzero(own == r) for r in range(1, 7)), np.count_nonzero(own), own.sum()], np.int64)
    rows.append((f"stats_{kind}", -1, shard, None, stats.tobytes()))
    return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "keys", "data"])


def _add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of counts of a task's shards."""
    for frame in frames:
        for kind, part in frame.groupby("kind"):
            total = sum(np.frombuffer(d, np.int64) for d in part["data"])
            yield pd.DataFrame({"kind": kind, "place": np.arange(len(total)), "value": total})


def _texts(docs: DataFrame, s: KatzSettings) -> DataFrame:
    """A row a chunk with its compressed texts, ids and folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, held, texts in _chunks(batches, s.chunk_chars):
            lengths = np.array([(len(t), f) for t, f in zip(texts, held, strict=True)], np.int64)
            head = json.dumps(ids).encode()
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join([head, *texts]))
            yield _batch([("t", chunk, 0, np.append(lengths.ravel(), len(head)).tobytes(), blob)])

    return docs.mapInArrow(run, _FIELDS)


def _read_texts(row) -> tuple[list[str | None], np.ndarray, list[bytes]]:
    *lengths, head = np.frombuffer(row["keys"], np.int64)
    lengths = np.array(lengths, np.int64).reshape(-1, 2)
    blob = zstandard.ZstdDecompressor().decompress(row["data"])
    ends = head + np.cumsum(lengths[:, 0])
    return json.loads(blob[:head]), lengths[:, 1].astype(bool), [blob[e - n : e] for e, n in zip(ends, lengths[:, 0], strict=True)]


def _answers(frame: pd.DataFrame, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and flags from the shards' answers, in the order of the keys."""
    total, flag = np.zeros(len(keys), np.uint64), np.zeros(len(keys), bool)
    found = {int(r["shard"]): r for _, r in frame.iterrows()}
    for k, at in _by_shard(keys, shards):
        answer = _unpack(found[k]["keys"], np.uint64)
        if len(answer) != len(at):
            raise RuntimeError("a chunk changed between two readings of the input")
        total[at], flag[at] = answer, np.unpackbits(np.frombuffer(found[k]["data"], np.uint8), count=len(at)).astype(bool)
    return total, flag


def _score_chunk(g: KatzNumbers, shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        chunk = int(frame["chunk"].iloc[0])
        ids, held, texts = _read_texts(frame[frame["kind"] == "t"].iloc[0])
        token, before, lengths = _tokens(texts)
        words, _, place, previous = _contexts(token, before, np.ones(len(token), bool))
        count, needed = _answers(frame[frame["kind"] == "u"], words, shards)
        pairs, pair_of, back = np.unique(_pairs(before, token), return_index=True, return_inverse=True)
        pair_count, owned = _answers(frame[frame["kind"] == "b"], pairs, shards)
        unigram = g.unigram(count)

        # What the words seen after each context take, from the pairs owned here.
        own = np.flatnonzero(owned & (pair_count > 0))
        context = previous[pair_of[own]]
        own, context = own[needed[context]], context[needed[context]]
        sums = [
            np.bincount(context, x, len(words))
            for x in (pair_count[own].astype(float), g.discounted(pair_count[own]), unigram[place[pair_of[own]]])
        ]
        with_own = np.flatnonzero(sums[0] > 0)
        rows = []
        for k, at in _by_shard(words[with_own], shards):
            at = with_own[at]
            rows.append(("a", chunk, k, _pack_sorted(words[at]), b"".join(x[at].tobytes() for x in sums)))

        # Known now: seen pairs, and contexts never seen. Open: alpha of the other contexts, and
        # whether a frequent context has words after it that leave any mass at all.
        c, before_count = pair_count[back], count[previous]
        seen = c > 0
        log = np.where(seen, np.log10(np.maximum(g.discounted(c), 1e-300)) - np.log10(np.maximum(before_count, 1)), np.log10(unigram[place]))
        small = np.bincount(previous, seen & (c <= _LARGEST), len(words)) > 0
        open_ = (~seen & (before_count > 0)) | (seen & ~small[previous] & (before_count > _LARGEST))
        asked, at = np.unique(previous[open_], return_inverse=True)
        for k, places in _by_shard(words[asked], shards):
            rows.append(("r", chunk, k, _pack_sorted(words[asked[places]]), None))
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), lengths)[open_]
        base = np.log10((count[place] + 0.5) / (g.tokens + 0.5 * (g.distinct + 1)))
        known = sums_by_text((count[place] > 0).astype(float), lengths)
        table = np.stack([held, lengths, known, sums_by_text(base, lengths), sums_by_text(log, lengths)]).astype(float)
        head = zstandard.ZstdCompressor(level=1).compress(json.dumps(ids).encode())
        open_rows = _pack(np.stack([doc, (at.astype(np.uint32) << np.uint32(1)) | seen[open_]], 1).astype(np.uint32).view(np.uint64).ravel())
        asked_words = _pack_sorted(words[asked])
        parts = [head, table.tobytes(), open_rows, asked_words]
        sizes = np.array([len(ids), *map(len, parts)], np.int64)
        rows.append(("p", chunk, -1, None, sizes.tobytes() + b"".join(parts)))
        return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "keys", "data"])

    return run


def _alpha(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's backoff weights, answered to every chunk that asked: log10 of alpha, log10 of the
    factor on seen words if nothing was left."""
    sums, asked = frame[frame["kind"] == "a"].sort_values("chunk"), frame[frame["kind"] == "r"]
    keys = [_unpack_sorted(k) for k in sums["keys"]]
    values = [np.frombuffer(d).reshape(3, -1) for d in sums["data"]]
    every, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    total, kept, below = (np.bincount(place, x, len(every)) for x in np.concatenate([np.zeros((3, 0)), *values], axis=1))
    none_left = kept >= total * (1 - 1e-12)
    # Words seen after v that leave nothing share their mass with one occurrence more.
    mass = np.where(none_left, 1 / (total + 1), 1 - kept / np.maximum(total, 1))
    log_alpha = np.log10(mass) - np.log10(np.maximum(1 - below, 1e-300))
    factor = np.where(none_left, np.log10(total / (total + 1)), 0.0)
    rows = []
    for chunk, shard, k in zip(asked["chunk"], asked["shard"], asked["keys"], strict=True):
        at = np.searchsorted(every, _unpack_sorted(k))
        rows.append(("z", chunk, shard, None, np.stack([log_alpha[at], factor[at]]).tobytes()))
    return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "keys", "data"])


def _finish(shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data = frame[frame["kind"] == "p"].iloc[0]["data"]
        n, *sizes = np.frombuffer(data[:40], np.int64)
        ends = 40 + np.cumsum(sizes)
        head, table, open_rows, asked = (data[a:b] for a, b in zip([40, *ends[:-1]], ends, strict=True))
        ids = json.loads(zstandard.ZstdDecompressor().decompress(head))
        held, lengths, known, base, score = np.frombuffer(table).reshape(5, n)
        words = _unpack_sorted(asked)
        values, found = np.zeros((2, len(words))), {int(r["shard"]): r["data"] for _, r in frame[frame["kind"] == "z"].iterrows()}
        for k, at in _by_shard(words, shards):
            values[:, at] = np.frombuffer(found[k]).reshape(2, -1)
        doc, at = _unpack(open_rows, np.uint64).view(np.uint32).reshape(-1, 2).T
        score = score + np.bincount(doc, values[at & 1, at >> 1], n)
        return pd.DataFrame(
            {
                "key": ids, "held_out": held.astype(bool), "n_tokens": lengths.astype(np.int64),
                "n_known": known.astype(np.int64), "base_score": base, "score": score,
            }
        )

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held: str = "held_out", settings: KatzSettings = KatzSettings()) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows with ``held`` false. A null text is the empty text,
    whose only token is its end; rows with equal or null keys are kept apart.
    The documents are read twice and must come in the same partitions both
    times, as a table does; a difference is an error. A chunk's counts are
    32-bit; totals over chunks, and N, are 64-bit, so no count wraps.
    """
    s, spark = settings, docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    rows = rows.withColumn("part", F.spark_partition_id())
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, math.ceil(size / s.shard_bytes))
    counted = written(_requests(rows, shards, s).groupBy("kind", "shard").applyInPandas(_count, _FIELDS), "counts")
    numbers = counted.where("kind like 'stats%'").select("kind", "data").mapInPandas(_add_up, "kind string, place int, value long")
    stats: dict[str, np.ndarray] = {}
    for r in numbers.groupBy("kind", "place").agg(F.sum("value").alias("value")).collect():  # eight numbers a kind
        stats.setdefault(r["kind"][-1], np.zeros(8, np.int64))[r["place"]] = r["value"]
    g = _numbers(stats)
    asked = counted.where("kind in ('u', 'b')").unionByName(_texts(rows, s))
    scored = written(asked.groupBy("chunk").applyInPandas(_score_chunk(g, shards), _FIELDS), "chunks")
    alphas = scored.where("kind in ('a', 'r')").groupBy("shard").applyInPandas(_alpha, _FIELDS)
    done = scored.where("kind = 'p'").unionByName(alphas).groupBy("chunk").applyInPandas(
        _finish(shards), "key string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    kind = docs.schema[key].dataType
    return done.select(
        F.col("key").cast(kind).alias(key), "held_out", "n_tokens", "n_known", F.lit(g.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
