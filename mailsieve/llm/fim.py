"""Fill-in-middle by secondary-sort assembly.

Every document is cut at two places chosen by a hash of its id into prefix,
middle and suffix, and re-ordered behind sentinel strings. The output is never
built as one string: each segment is emitted as pieces of at most ``unit``
code points, keyed by the row and by their place in the output. The pieces are
dealt by row and sorted within partitions (the DataFrame form of
repartitionAndSortWithinPartitions), and a streaming pass feeds them into one
incremental digest a row. For the restoration the same dealt pieces, sentinels
left out, are sorted again by their place in the restored text and digested
the same way. Memory in a task is one piece and a few digests, whatever the
length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.llm.frames import put_back, set_apart, slices

# The three sentinels of the output, and their order by form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# psm: <P> prefix <S> suffix <M> middle; spm: <S> suffix <P> prefix <M> middle.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SENTINEL = {"prefix": PREFIX, "suffix": SUFFIX, "middle": MIDDLE}
RESTORED = ("prefix", "middle", "suffix")


def _group(h: Column, k: int) -> Column:
    """The k-th 8-digit hex group of a digest as an unsigned integer."""
    return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")


def cuts(doc_id: Column, text: Column, seed: str = "1") -> dict[str, Column]:
    """n, the form and the two cut places of a text (null text: empty; null id: the empty id)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("long")
    a, b = F.pmod(_group(h, 0), n + 1), F.pmod(_group(h, 1), n + 1)
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    plain = (n == 0) | marked | (F.pmod(_group(h, 2), F.lit(100)) >= 90)
    form = F.when(plain, "plain").when(F.pmod(_group(h, 3), F.lit(100)) < 20, "spm").otherwise("psm")
    return {"n": n, "form": form, "low": F.least(a, b), "high": F.greatest(a, b)}


def _stream(to: str):
    """Per key, the sha256 of its pieces' texts in the order the partition is sorted in.

    Pieces come sorted by key and place; a place met twice in a row is the same
    piece again and is fed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, digest = None, None, hashlib.sha256()
        k1s, k2s, done = [], [], []
        for b in slices(batches, 256):
            cols = [b.column(c).to_pylist() for c in ("k1", "k2", "seg", "chunk", "piece")]
            for k1, k2, seg, chunk, piece in zip(*cols, strict=True):
                if (k1, k2) != current:
                    if current is not None:
                        k1s.append(current[0]), k2s.append(current[1]), done.append(digest.hexdigest())
                    current, place, digest = (k1, k2), None, hashlib.sha256()
                if (seg, chunk) != place:
                    digest.update(piece.encode("utf-8"))
                    place = (seg, chunk)
            if len(done) >= 4096:
                yield _batch(k1s, k2s, done, to)
                k1s, k2s, done = [], [], []
        if current is not None:
            k1s.append(current[0]), k2s.append(current[1]), done.append(digest.hexdigest())
        if done:
            yield _batch(k1s, k2s, done, to)

    return run


def _batch(k1s: list, k2s: list, done: list, to: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array(done, pa.string())], ["k1", "k2", to]
    )


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: int = 1 << 16) -> DataFrame:
    """All columns of ``docs`` and n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    One row a row of ``docs``, also for repeated rows and equal ids. The output
    depends on id and text alone, so rows equal in both are transformed once
    (their copies are folded before any text moves, map-side first) and share
    the result. A null text is the empty text and plain; a null id is hashed as
    the empty id. Texts that hold a sentinel are plain, so sentinels in an
    output are always the operator's own and mark the segments unambiguously.
    prefix_chars and middle_chars are null for plain rows. The digests are
    lowercase hex sha256 of the UTF-8 output and of the text restored from it
    (the empty text's digest when there is no text). Texts of any length are
    whole; columns of ``docs`` may have any names, those of the result win.
    """
    out_cols = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    base, names = set_apart(docs, *out_cols)
    i = F.col(names[id_col]) if id_col in names else F.lit(None).cast("long")
    t = F.coalesce(F.col(names[text]), F.lit("")) if text in names else F.lit("")
    # Two independent 64-bit hashes of (id, text) name a document.
    who = [F.coalesce(i.cast("string"), F.lit("\x00")), t]
    c = cuts(i, t)
    # The numbers of the cut are made beside the text, so that the text need not travel to the end.
    keyed = base.withColumns(
        {"k1": F.xxhash64(F.lit("k1"), *who), "k2": F.xxhash64(F.lit("k2"), *who), **{f"__{k}": v for k, v in c.items()}}
    )
    spans = keyed.select("k1", "k2", t.alias("t"), *[F.col(f"__{k}").alias(k) for k in c]).dropDuplicates(["k1", "k2"])
    # (segment, first code point, length): places in the output, and in the restored text.
    seg = {
        "prefix": (F.lit(0).cast("long"), F.col("low")),
        "middle": (F.col("low"), F.col("high") - F.col("low")),
        "suffix": (F.col("high"), F.col("n") - F.col("high")),
    }
    kind = "struct<mark string, at long, len long, out int, back int>"

    def segment(name: str, out: int) -> Column:
        at, length = seg[name]
        return F.struct(F.lit(SENTINEL[name]), at, length, F.lit(out), F.lit(RESTORED.index(name))).cast(kind)

    whole = F.struct(F.lit(None).cast("string"), F.lit(0).cast("long"), F.col("n"), F.lit(0), F.lit(0)).cast(kind)
    layout = (
        F.when(F.col("form") == "plain", F.array(whole))
        .when(F.col("form") == "psm", F.array(*[segment(s, j) for j, s in enumerate(ORDER["psm"])]))
        .otherwise(F.array(*[segment(s, j) for j, s in enumerate(ORDER["spm"])]))
    )
    segs = spans.select("k1", "k2", "t", F.explode(layout).alias("s"))
    # Chunk -1 is the sentinel, a piece of its own before its segment; plain texts have none.
    first = F.when(F.col("s.mark").isNotNull(), -1).otherwise(0).cast("long")
    last = F.ceil(F.col("s.len") / unit).cast("long") - 1
    chunks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    # One generator after the fold of copies: every piece stays in its document's partition.
    pieces = segs.select("k1", "k2", "t", "s", F.explode(chunks).alias("chunk")).select(
        "k1", "k2", F.col("s.out").alias("seg"), "chunk",
        F.when(F.col("chunk") >= 0, F.col("s.back")).otherwise(-1).alias("back"),
        F.when(F.col("chunk") < 0, F.col("s.mark")).otherwise(F.substring(
            F.col("t"), (F.col("s.at") + F.col("chunk") * unit + 1).cast("int"),
            F.least(F.lit(unit).cast("long"), F.col("s.len") - F.col("chunk") * unit).cast("int"),
        )).alias("piece"),
    )
    fields = "k1 long, k2 long, {} string"
    out = pieces.sortWithinPartitions("k1", "k2", "seg", "chunk").mapInArrow(
        _stream("output_sha256"), fields.format("output_sha256")
    )
    back = (
        pieces.where(F.col("back") >= 0).withColumn("seg", F.col("back"))
        .sortWithinPartitions("k1", "k2", "seg", "chunk")
        .mapInArrow(_stream("restored_sha256"), fields.format("restored_sha256"))
    )
    empty = hashlib.sha256(b"").hexdigest()
    plain = F.col("__form") == "plain"
    return keyed.join(out, ["k1", "k2"], "left").join(back, ["k1", "k2"], "left").select(
        *put_back(names), F.col("__n").alias("n"), F.col("__form").alias("form"),
        F.when(~plain, F.col("__low")).alias("prefix_chars"),
        F.when(~plain, F.col("__high") - F.col("__low")).alias("middle_chars"),
        F.coalesce("output_sha256", F.lit(empty)).alias("output_sha256"),
        F.coalesce("restored_sha256", F.lit(empty)).alias("restored_sha256"),
    )


def render(text: str | None, doc_id: int | None, seed: str = "1") -> tuple[str, str]:
    """(form, output) of one text in plain Python: the brute-force statement of the contract."""
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    n = len(t)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 90:
        return "plain", t
    p, m, s = t[:low], t[low:high], t[high:]
    return ("spm", SUFFIX + s + PREFIX + p + MIDDLE + m) if h4 % 100 < 20 else ("psm", PREFIX + p + SUFFIX + s + MIDDLE + m)


def restore(form: str, output: str) -> str:
    """The text an output stands for, found by its sentinels."""
    if form == "plain":
        return output
    if form == "psm":
        p, rest = output[len(PREFIX):].split(SUFFIX, 1)
        s, m = rest.split(MIDDLE, 1)
    else:
        s, rest = output[len(SUFFIX):].split(PREFIX, 1)
        p, m = rest.split(MIDDLE, 1)
    return p + m + s
