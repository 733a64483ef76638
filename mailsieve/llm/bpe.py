"""BPE encoding and decoding with tree concatenation of long unsplit text.

Ordinary text is cut where a letter or digit, one space, and a letter or digit
meet. The tokenizer's own pattern always starts a new piece at such a space,
whatever stands around it, so tokens on both sides never depend on each other.

A piece of the pattern that is very long (no such cut exists, as in base64, or
in a script without spaces) is halved again and again. The leaves are encoded
in parallel as rows of their own. Halves are joined by encoding the text of a
window around the join again; the window grows until its first token is the
left half's and its last token the right half's. A sequence of BPE tokens is
the encoding of its text exactly when every two neighbours are the encoding of
theirs, so agreement at both ends makes the whole sequence exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mailsieve.llm.frames import slices

_CUT = re.compile(r"[^\W_] (?=[^\W_])")
_BATCH_CHARS = 1 << 20
_PIECE_CHARS = 1 << 16


class _Memo(dict):
    """What a task has loaded. Travels empty, so that functions can be sent to workers by value."""

    def __reduce__(self):
        return _Memo, ()

    def once(self, make: Callable, *key):
        if (make.__name__, *key) not in self:
            self[(make.__name__, *key)] = make(*key)
        return self[(make.__name__, *key)]


_memo = _Memo()


def _load(path: str, split: bool = True):
    """A task's tokenizer; with ``split`` off its pattern is left out and only merges apply."""
    return _memo.once(_load_anew, path, split)


def _load_anew(path: str, split: bool):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    if not split:
        found.encode_special_tokens = True
        found.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return found


def _ids(path: str, texts: list[str]) -> list[np.ndarray]:
    fast, special = _memo.once(_ranked, path), list(_special(path))
    if fast and not any(mark in t for mark in special for t in texts):
        return [fast.encode_to_numpy(t, disallowed_special=()).astype("<u4") for t in texts]
    found = _load(path).encode_batch_fast(texts, add_special_tokens=False)
    return [np.array(e.ids, "<u4") for e in found]


def _tables(path: str) -> tuple[list[bytes], dict[str, int], bool]:
    """(bytes of every id, special tokens, whether the lowest rank is the first merge), from the file alone.

    In a byte-level vocabulary the visible Latin-1 characters stand for their
    own byte and the characters from 256 on for the other bytes in order.
    """
    import json

    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    special = {t["content"]: t["id"] for t in kind["added_tokens"]}
    before, model = kind["pre_tokenizer"] or {}, kind["model"]
    vocabulary = model["vocab"] | special
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        known = all(c in symbols for c in token)
        out[i] = bytes(symbols[c] for c in token) if known else token.encode()
    made = (m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"])
    in_order = all(model["vocab"][m] == 256 + k for k, m in enumerate(made))
    split = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    odd = kind["normalizer"] or model.get("ignore_merges") or model.get("dropout")
    return out, special, bool(split and in_order and not odd)


def _ranked(path: str):
    """The same vocabulary in the library that merges by rank, four times as fast on words seen once.

    Only for a plain byte-level tokenizer whose ids are in the order of its
    merges: both then give equal ids. None otherwise. Texts with special
    tokens never come here.
    """
    import public_tokenizers
    import tiktoken

    table, special, plain = _memo.once(_tables, path)
    if not plain:
        return None
    ranks = {b: i for i, b in enumerate(table) if i not in set(special.values())}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str, size: int) -> list[str]:
    """The text cut at spaces that always start a new piece, every ``size`` characters or more."""
    out, begin = [], 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if not cut:
            break
        out.append(text[begin : cut.start() + 1])
        begin = cut.start() + 1
    return [*out, text[begin:]]


def _encode_texts(path: str, texts: list[str]) -> Iterator[list[np.ndarray]]:
    """Ids of every text, in groups of a bounded number of characters."""
    group, size = [], 0
    for text in [*texts, None]:
        if text is None or size >= _BATCH_CHARS:
            cut = [_pieces(t, _PIECE_CHARS) for t in group]
            flat, out, at = _ids(path, [p for c in cut for p in c]), [], 0
            for c in cut:
                out.append(np.concatenate(flat[at : at + len(c)]))
                at += len(c)
            yield out
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)


def join_encoded(
    left: np.ndarray, right: np.ndarray, text_of: Callable[[np.ndarray], bytes],
    encode: Callable[[bytes], np.ndarray], window: int = 8,
) -> np.ndarray:
    """The encoding of two neighbouring texts from their own encodings."""
    while len(left) and len(right):
        i, j = min(window, len(left)), min(window, len(right))
        around = encode(text_of(np.concatenate([left[-i:], right[:j]])))
        agree_left = i == len(left) or around[0] == left[-i]
        agree_right = j == len(right) or around[-1] == right[j - 1]
        if agree_left and agree_right:
            return np.concatenate([left[: len(left) - i], around, right[j:]])
        window *= 2
    return np.concatenate([left, right])


def join_tree(parts: list[np.ndarray], text_of, encode) -> np.ndarray:
    """All parts joined pairwise, level by level."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [join_encoded(*p, text_of, encode) if len(p) == 2 else p[0] for p in pairs]
    return parts[0] if parts else np.zeros(0, "<u4")


def _codec(path: str):
    """Bytes of ids and ids of bytes. Windows may end within a character, so both stay in the
    byte alphabet of the vocabulary and never become text."""
    whole, model = _load(path, False), _load(path, False).model

    def text_of(ids: np.ndarray) -> str:
        return "".join(whole.id_to_token(int(i)) for i in ids)

    def encode(symbols: str) -> np.ndarray:
        return np.array([t.id for t in model.tokenize(symbols)], "<u4")

    return text_of, encode


def _special(path: str) -> dict[str, int]:
    return _memo.once(_tables, path)[1]


def _cut_long(path: str, text: str, leaf: int) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(piece, leaf, ids, symbols): short pieces come encoded, long ones as leaves to encode."""
    special = _special(path)
    marks = "|".join(map(re.escape, special)) or r"(?!)"
    splitter, piece = _load(path).pre_tokenizer, 0
    for part in (p for p in re.split(f"({marks})", text) if p):
        if part in special:
            yield piece, 0, np.array([special[part]], "<u4").tobytes(), None
            piece += 1
            continue
        short: list[str] = []
        _, encode = _codec(path)

        def flush():
            return np.concatenate([encode(s) for s in short]).tobytes()

        for symbols, _span in splitter.pre_tokenize_str(part):
            if len(symbols) <= leaf:
                short.append(symbols)
                continue
            if short:
                yield piece, 0, flush(), None
                piece, short = piece + 1, []
            for k in range(0, len(symbols), leaf):
                yield piece, k // leaf, None, symbols[k : k + leaf]
            piece += 1
        if short:
            yield piece, 0, flush(), None
            piece += 1


def encode(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", long_run: int = 16_384,
    leaf: int = 4_096,
) -> DataFrame:
    """The kept columns and ``ids``: every row's whole text as little-endian 32-bit ids in one binary value.

    A null text is the empty text and has no ids. Rows are kept one for one,
    also rows that are equal; columns not named in ``keep`` are left out. Texts with a
    run of ``long_run`` characters without a space, or of spaces alone, take
    the way by leaves of ``leaf`` bytes; all others never leave their row.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.col("text").rlike(f"[^ ]{{{long_run}}}| {{{long_run}}}")
    schema = T.StructType([rows.schema["key"], T.StructField("ids", T.BinaryType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = 0
            for found in _encode_texts(path, b.column("text").to_pylist()):
                ids = pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, len(found)), ids], ["key", "ids"])
                at += len(found)
        _memo.clear()  # a worker that goes on to other tasks keeps nothing

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for mark, copies, t in zip(frame["mark"], frame["copies"], frame["text"], strict=True):
                yield pd.DataFrame(
                    [(mark, copies, *x) for x in _cut_long(path, t, leaf)],
                    columns=["mark", "copies", "piece", "leaf", "ids", "symbols"],
                )

    def encode_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, ids = _codec(path)
            frame["ids"] = [i if i is not None else ids(s).tobytes() for i, s in zip(frame["ids"], frame["symbols"], strict=True)]
            yield frame.drop(columns="symbols")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece", "leaf"])
        codec = _codec(path)
        parts = [
            join_tree([np.frombuffer(b, "<u4") for b in g], *codec)
            for _, g in frame.groupby("piece", sort=True)["ids"]
        ]
        return pd.DataFrame(
            {"mark": [frame["mark"].iloc[0]], "copies": [frame["copies"].iloc[0]], "ids": [np.concatenate(parts).tobytes()]}
        )

    ordinary = rows.where(~long).mapInArrow(whole, schema)
    # Equal rows are cut once. The group of a text holds its own leaves and no more.
    few = rows.where(long).groupBy("key", "text").agg(F.count("*").alias("copies"))
    few = few.withColumn("mark", F.sha2(F.to_json(F.struct("key", "text"), {"ignoreNullFields": "false"}), 256))
    fields = "mark string, copies long, piece long, leaf long, ids binary"
    leaves = few.select("mark", "copies", "text").mapInPandas(cut, f"{fields}, symbols string")
    spread = leaves.repartition("mark", "piece", "leaf").mapInPandas(encode_leaves, fields)
    joined = spread.groupBy("mark").applyInPandas(join, "mark string, copies long, ids binary")
    tree = few.select("mark", "key").join(joined, "mark").select(
        "key", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")
    )
    return ordinary.unionByName(tree.select("key", "ids")).select(*[F.col("key").getField(c).alias(c) for c in keep], "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns and the text that the ids stand for; null ids are no ids.

    Bytes that are no UTF-8, which only foreign ids can give, become U+FFFD.
    """
    base = encoded.drop(to)
    schema = T.StructType([*base.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _memo.once(_tables, path)[0]
        for b in slices(batches):
            values = b.column(b.schema.get_field_index(ids))
            found = [
                b"".join([table[i] for i in np.frombuffer(v.as_py() or b"", "<u4").tolist()]).decode("utf-8", "replace") for v in values
            ]
            named = pa.schema([*b.schema, pa.field(to, pa.string())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], schema=named)
        _memo.clear()

    return base.mapInArrow(run, schema)
