"""TF-IDF over word n-grams: vocabulary, weights and their joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from mailsieve.functions.text import fold_accents, words_apart
from mailsieve.operators.lineage import lookup, stored

_BROADCAST_TERMS = 1_000_000
_INDEX_BUCKETS = 1024
# What an Arrow pass takes at once: texts by bytes, counted terms by number.
_BYTES_AT_ONCE, _ENTRIES_AT_ONCE = 2 << 20, 1 << 18


@dataclass(frozen=True)
class TfidfSettings:
    ngram_min: int = 1
    ngram_max: int = 2
    min_df: int | float = 2
    max_df: int | float = 0.95
    max_features: int | None = 50_000
    sublinear_tf: bool = True


def message_words(
    messages: DataFrame, keep: Sequence[str] = ("id",), text: str = "text", folded: Column | None = None,
) -> DataFrame:
    """``terms`` holds every message's words, as one text without accents in which a space parts them.

    ``build_vocabulary``, ``weigh_terms`` and ``tfidf`` take this frame as they
    take ``term_frequencies``, and count its n-grams without spelling out those
    of every message.
    """
    spaced = words_apart(fold_accents(text) if folded is None else folded)
    return messages.select(*keep, spaced.alias("terms"))


def _are_words(frame: DataFrame) -> bool:
    return isinstance(frame.schema["terms"].dataType, T.StringType)


def term_frequencies(
    messages: DataFrame, keep: Sequence[str] = ("id",), text: str = "text",
    settings: TfidfSettings = TfidfSettings(), folded: Column | None = None,
) -> DataFrame:
    """Every message's distinct n-grams with their counts, as one array in the order of the n-grams.

    ``folded`` gives the text without accents where it is there already. An
    Arrow pass numbers the words of some messages and sorts the n-grams as
    numbers, so no token leaves its row and nothing is shuffled.
    """
    spaced = words_apart(fold_accents(text) if folded is None else folded)
    rows = messages.select(*keep, spaced.alias("_words"))
    entry = T.StructType().add("term", "string").add("tf", "integer")
    kept = [f for f in rows.schema if f.name != "_words"]
    schema = T.StructType([*kept, T.StructField("terms", T.ArrayType(entry))])
    shortest, longest = settings.ngram_min, settings.ngram_max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, "_words"):
            words = b.column(b.schema.get_field_index("_words"))
            columns = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, _count_ngrams(words, shortest, longest)], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut where the column's values (texts, or lists of entries) reach a bounded size, so that what is made of them at once is bounded."""
    for b in batches:
        values = b.column(b.schema.get_field_index(column))
        if pa.types.is_list(values.type):
            size, limit = pc.list_value_length(values), _ENTRIES_AT_ONCE
        else:
            size, limit = pc.binary_length(values), _BYTES_AT_ONCE
        group = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for begin, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(begin, end - begin)


def _count_ngrams(texts: pa.Array, shortest: int, longest: int) -> pa.ListArray:
    """The sorted distinct n-grams of every text with their counts; words are parted by one space.

    An n-gram is a row of its words' ranks, shorter ones filled up by 0. A space
    sorts before all that a word can hold, so ranks sort as the n-grams do.
    """
    size, row, vocabulary, ranks = _numbered(texts)
    row, places, tf = _distinct(row, ranks, len(vocabulary) + 1, shortest, longest)
    terms = _spelled(vocabulary, places)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([terms, pa.array(tf)], ["term", "tf"]))


def _numbered(texts: pa.Array) -> tuple[int, np.ndarray, pa.Array, np.ndarray]:
    """(number of texts, text of each word, distinct words in order, rank of each word from 1)."""
    lists = pc.split_pattern(texts, " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    long = pc.greater(pc.utf8_length(words), 1)
    row = np.repeat(np.arange(len(sizes)), sizes)[long.to_numpy(zero_copy_only=False)]
    coded = words.filter(long).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return len(sizes), row, vocabulary, rank[coded.indices.to_numpy()]


def _spelled(vocabulary: pa.Array, places: list[np.ndarray]) -> pa.Array:
    parts = [vocabulary.take(pa.array(np.maximum(p - 1, 0), mask=p == 0)) for p in places]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _distinct(
    row: np.ndarray, ranks: np.ndarray, base: int, shortest: int, longest: int, known: bool = False,
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(text, ranks, count) of every text's distinct n-grams, in their order; with ``known`` only those without a rank of 0."""
    rows, places = [], [[] for _ in range(longest)]
    for n in range(max(shortest, 1), longest + 1):
        m = max(len(ranks) - n + 1, 0)
        whole = row[:m] == row[len(row) - m :]
        for i in range(n if known else 0):
            whole &= ranks[i : i + m] > 0
        rows.append(row[:m][whole])
        for i in range(longest):
            places[i].append(ranks[i : i + m][whole] if i < n else np.zeros(len(rows[-1]), np.int64))
    row, places = np.concatenate(rows), [np.concatenate(p) for p in places]
    texts = int(row.max()) + 1 if len(row) else 0
    if texts * base**longest < 1 << 62:
        # A number holds text and ranks, so it is sorted alone and taken apart again.
        packed = row.astype(np.int64)
        for p in places:
            packed = packed * base + p
        packed.sort()
        first = np.flatnonzero(np.diff(packed, prepend=-1))
        tf, packed = np.diff(np.append(first, len(packed))).astype(np.int32), packed[first]
        out = []
        for _ in range(longest):
            packed, p = np.divmod(packed, base)
            out.append(p)
        return packed, out[::-1], tf
    keys = [row, *places]
    by = np.lexsort(keys[::-1])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in keys])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(by))).astype(np.int32)
    return row[by[first]], [p[by[first]] for p in places], tf


def _counted_words(words: DataFrame, settings: TfidfSettings) -> DataFrame:
    """``_counted`` of words: a task sends a piece's distinct n-grams, added up over its messages."""
    schema = "term string, df long, total long, firsts long"
    shortest, longest = settings.ngram_min, settings.ngram_max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, "terms"):
            size, row, vocabulary, ranks = _numbered(b.column(0))
            _, places, tf = _distinct(row, ranks, len(vocabulary) + 1, shortest, longest)
            by = np.lexsort(places[::-1])
            new = np.ones(len(by), bool)
            if len(by):
                new[1:] = np.logical_or.reduce([p[by[1:]] != p[by[:-1]] for p in places])
            first = np.flatnonzero(new)
            df = np.diff(np.append(first, len(by)))
            total = np.add.reduceat(tf[by].astype(np.int64), first) if len(by) else np.zeros(0, np.int64)
            terms = _spelled(vocabulary, [p[by[first]] for p in places])
            zero = np.zeros(len(df), np.int64)
            rows = [terms, pa.array(df, pa.int64()), pa.array(total, pa.int64()), pa.array(zero)]
            yield pa.RecordBatch.from_arrays(rows, ["term", "df", "total", "firsts"])
            # The piece's messages, in a row of a null term.
            yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "df": [0], "total": [0], "firsts": [size]})

    found = words.select("terms").mapInArrow(run, schema)
    return found.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "total", "firsts")])


def _counted(frequencies: DataFrame) -> DataFrame:
    """(term, df, total, firsts): a row a term, and one of a null term for messages without any.

    ``firsts`` counts the messages whose first entry the term is, so its sum is
    the number of all messages and takes no pass of its own. The outer explode
    keeps Catalyst from adding a filter on the array's size, which it would
    push down by copying all that computes the array.
    """
    rows = frequencies.select(F.posexplode_outer("terms").alias("_place", "_t"))
    return rows.groupBy(F.col("_t.term").alias("term")).agg(
        F.count("*").alias("df"), F.sum("_t.tf").alias("total"), F.count_if(F.coalesce("_place", F.lit(0)) == 0).alias("firsts")
    )


def term_statistics(frequencies: DataFrame) -> DataFrame:
    """Documents and occurrences of every term; one partial row a term leaves each task."""
    return _counted(frequencies).where("term is not null").select("term", "df", "total")


def top_terms(stats: DataFrame, k: int) -> DataFrame:
    """The k terms with most occurrences, ties by term.

    A histogram over powers of two, at most 64 rows, gives a floor that at
    least k terms reach. Only the terms above it are sorted.
    """
    power = F.length(F.bin("total"))
    powers = stats.groupBy(power.alias("_power")).agg(F.count("*").alias("_n"))
    down = W.partitionBy(F.lit(0)).orderBy(F.desc("_power"))
    floor = (
        powers.select("_power", F.sum("_n").over(down).alias("_reached"))
        .where(F.col("_reached") >= k)
        .agg(F.max("_power").alias("_floor"))
    )
    return (
        stats.where(power >= F.coalesce(floor.scalar(), F.lit(0)))
        .orderBy(F.desc("total"), "term")
        .limit(k)
    )


def build_vocabulary(
    frequencies: DataFrame, settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """Terms within the document-frequency bounds, the top ones by count, with idf.

    The messages are counted once: their number and the cut of the top terms
    are taken from the written statistics.
    """
    given = _counted_words(frequencies, settings) if _are_words(frequencies) else _counted(frequencies)
    counted = stored(given, "statistics")
    rows = F.lit(counted.agg(F.sum("firsts")).head()[0] or 0)

    def bound(limit: int | float) -> Column:
        return F.lit(limit) if isinstance(limit, int) else F.lit(float(limit)) * rows

    stats = counted.drop("firsts").where(
        F.col("term").isNotNull() & (F.col("df") >= bound(settings.min_df)) & (F.col("df") <= bound(settings.max_df))
    )
    if settings.max_features is not None:
        stats = top_terms(stats, settings.max_features)
    return stats.select(
        "term", "df", "total", (F.log((1 + rows) / (1 + F.col("df"))) + 1).alias("idf")
    )


def index_terms(vocabulary: DataFrame) -> DataFrame:
    """Adds a dense index 0..n-1: place in a hash bucket plus the buckets before.

    The only global order is over the buckets' sizes.
    """
    bucketed = vocabulary.withColumn("_bucket", F.pmod(F.xxhash64("term"), F.lit(_INDEX_BUCKETS)))
    before = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .count()
        .select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("term"))
    return (
        bucketed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket")  # one row a bucket
        .withColumn("index", (F.col("_offset") + F.col("_place") - 1).cast("int"))
        .drop("_bucket", "_place", "_offset")
    )


def term_weight(settings: TfidfSettings) -> Column:
    tf = F.col("tf").cast("double")
    return ((1 + F.log(tf)) if settings.sublinear_tf else tf) * F.col("idf")


def known_terms(
    frequencies: DataFrame, vocabulary: DataFrame, settings: TfidfSettings, outer: bool = False
) -> DataFrame:
    """One row a message and known term; with ``outer`` also messages without any.

    Joined by ``lookup``, which spreads the terms that are in most messages.
    """
    keep = [c for c in frequencies.columns if c != "terms"]
    long = frequencies.select(*keep, F.explode_outer("terms").alias("_t"))
    long = long.select(*keep, "_t.term", "_t.tf")
    how = "left" if outer else "inner"
    return lookup(long, vocabulary, "term", spread_by=F.col(keep[0]), how=how)


class _Numbers:
    """The vocabulary's terms as numbers made of their words' ranks, to look n-grams up without spelling them."""

    def __init__(self, known: pa.Array, longest: int):
        lists = pc.split_pattern(known, " ")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.words = pc.unique(lists.flatten())
        self.words = self.words.take(pc.sort_indices(self.words))
        self.base, self.longest = len(self.words) + 1, longest
        ranks = pc.index_in(lists.flatten(), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        row, starts = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        places = np.zeros((len(lengths), max(longest, int(lengths.max(initial=0)))), np.int64)
        places[row, np.arange(len(row)) - starts[row]] = ranks
        inside = np.flatnonzero(lengths <= longest)
        packed = self._pack(list(places[inside, :longest].T)) if self.fit(1) else np.zeros(0, np.int64)
        by = np.argsort(packed)
        self.keys, self.place = packed[by], inside[by] if len(packed) else inside[:0]

    def fit(self, rows: int) -> bool:
        return rows * self.base**self.longest < 1 << 62

    def _pack(self, places: list[np.ndarray]) -> np.ndarray:
        packed = np.zeros(len(places[0]), np.int64)
        for p in places:
            packed = packed * self.base + p
        return packed

    def found(self, texts: pa.Array, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the vocabulary, count) of the known n-grams."""
        lists = pc.split_pattern(texts, " ")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = lists.flatten()
        long = pc.greater(pc.utf8_length(words), 1)
        row = np.repeat(np.arange(len(sizes)), sizes)[long.to_numpy(zero_copy_only=False)]
        ranks = pc.fill_null(pc.index_in(words.filter(long), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        row, places, tf = _distinct(row, ranks, self.base, shortest, self.longest, known=True)
        packed = self._pack(places)
        at = np.minimum(np.searchsorted(self.keys, packed), max(len(self.keys) - 1, 0))
        there = np.flatnonzero(self.keys[at] == packed) if len(self.keys) else np.zeros(0, np.int64)
        return row[there], self.place[at[there]], tf[there]


def weigh_terms(
    frequencies: DataFrame, vocabulary: DataFrame, settings: TfidfSettings = TfidfSettings(),
) -> DataFrame:
    """Replaces ``terms`` by ``weights``, the known terms with their unit-length weights.

    One Arrow pass with the vocabulary, which ``max_features`` bounds; rows stay
    in place, so nothing is shuffled and no two rows can be taken for one. An
    entry has the term and its ``index`` in the vocabulary (null if that has
    none). Where the vocabulary has ``weight``, ``dot`` is the product with it.
    """
    if settings.max_features is None or settings.max_features > _BROADCAST_TERMS:
        raise ValueError(f"max_features must be set, to {_BROADCAST_TERMS} at most")
    with_index, with_dot = "index" in vocabulary.columns, "weight" in vocabulary.columns
    wanted = ["term", "idf", *(["index"] if with_index else []), *(["weight"] if with_dot else [])]
    shared = frequencies.sparkSession.sparkContext.broadcast(vocabulary.select(*wanted).toArrow().combine_chunks())
    keep, words = [f for f in frequencies.schema if f.name != "terms"], _are_words(frequencies)
    entry = T.StructType().add("term", "string").add("index", "integer").add("value", "double")
    schema = T.StructType([*keep, T.StructField("weights", T.ArrayType(entry)), T.StructField("dot", T.DoubleType())])
    sublinear, shortest, longest = settings.sublinear_tf, settings.ngram_min, settings.ngram_max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known = table.column("term").combine_chunks() if table.num_rows else pa.array([], pa.string())
        idf = table.column("idf").to_numpy()
        places = table.column("index").to_numpy().astype(np.int32) if with_index else None
        weight = table.column("weight").to_numpy() if with_dot else None
        numbers = _Numbers(known, longest) if words else None
        for b in _pieces(batches, "terms"):
            lists = b.column(b.schema.get_field_index("terms"))
            sizes = np.zeros(b.num_rows)
            if numbers is not None and numbers.fit(b.num_rows):
                row, place, tf = numbers.found(lists, shortest)
            else:
                lists = lists if numbers is None else _count_ngrams(lists, shortest, longest)
                flat, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                found = pc.index_in(flat.field("term"), value_set=known)
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                place = pc.take(found, pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), lengths)[at]
                tf = flat.field("tf").to_numpy(zero_copy_only=False)[at]
            tf = tf.astype(np.float64)
            value = ((1 + np.log(tf)) if sublinear else tf) * idf[place]
            value = value / np.sqrt(np.bincount(row, value * value, len(sizes)))[row]
            index = pa.array(places[place], pa.int32()) if with_index else pa.nulls(len(place), pa.int32())
            entries = pa.StructArray.from_arrays(
                [pc.take(known, pa.array(place, pa.int64())), index, pa.array(value, pa.float64())], ["term", "index", "value"]
            )
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
            weights = pa.ListArray.from_arrays(pa.array(offsets), entries)
            dot = np.bincount(row, value * weight[place], len(sizes)) if with_dot else np.zeros(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(f.name)) for f in keep), weights, pa.array(dot, pa.float64())], [f.name for f in schema]
            )

    return frequencies.mapInArrow(run, schema)


def tfidf(
    frequencies: DataFrame, vocabulary: DataFrame, settings: TfidfSettings = TfidfSettings(),
    key: str = "id",
) -> DataFrame:
    """Long table (id, term, weight), each message at unit length; messages with one id stay apart.

    Within the row where ``max_features`` bounds the vocabulary. Otherwise the
    terms are joined, and the norm is a window whose group is one message.
    """
    if settings.max_features is not None and settings.max_features <= _BROADCAST_TERMS:
        weighed = weigh_terms(frequencies.select(key, "terms"), vocabulary.select("term", "idf"), settings)
        rows = weighed.select(key, F.explode_outer("weights").alias("_w")).where("_w is not null")
        return rows.select(key, "_w.term", F.col("_w.value").alias("weight"))
    if _are_words(frequencies):
        frequencies = term_frequencies(frequencies, [key], settings=settings, folded=F.col("terms"))
    numbered = frequencies.select(key, F.monotonically_increasing_id().alias("_message"), "terms")
    raw = known_terms(numbered, vocabulary, settings).select(
        key, "_message", "term", term_weight(settings).alias("_raw")
    )
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy("_message")))
    return raw.select(key, "term", (F.col("_raw") / norm).alias("weight"))


def fit_tfidf(
    train: DataFrame, text: str = "text", settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """Vocabulary of a training frame."""
    return build_vocabulary(message_words(train, (), text), settings)
