"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of
one to three characters are hashed to a fixed number of buckets. The weights are
trained with follow-the-regularised-leader (FTRL-proximal) and an elastic-net
penalty. Shards of the sample train side by side and their states are averaged
after every pass, slice by slice of the buckets and in tasks; the driver sees
only the last weights. A temperature, found on rows kept out of the training, makes
the probabilities honest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mailsieve.llm.frames import fold, mix, slices, written

_OTHER = re.compile(r"[\W\d_]+")
_ORDERS = 3
# Buckets in a row of a state.
_SLICE = 4_096
_STATE = "slice int, z binary, n binary"
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    """``rows_per_language`` bounds the labelled rows that are learned from (in expectation: rows
    are chosen by hash at a rate); ``buckets`` bounds the weights."""

    rows_per_language: int = 1_500
    buckets: int = 1 << 16
    shards: int = 4
    passes: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    seed: int = 42


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    settings: LanguageSettings


def _buckets(text: str, n: int) -> np.ndarray:
    """Hashed n-grams of the whole text, one for every place and order."""
    letters = _OTHER.sub(" ", f" {text.lower()} ")
    points = np.frombuffer(letters.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    key, parts = np.zeros(len(points), np.uint64), []
    for order in range(1, _ORDERS + 1):
        key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) if order > 1 else key
        key = key + points[order - 1 :] + np.uint64(order)
        parts.append(mix(key))
    return (np.concatenate(parts) % np.uint64(n)).astype(np.int64)


def _terms(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with dampened counts; none if the text has no letter."""
    if not text or not re.search(r"[^\W\d_]", text):
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.bincount(_buckets(text, n), minlength=n)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


def _weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = tf * idf[at]
    return values / (np.sqrt(values @ values) or 1.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray, s: LanguageSettings) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def _ftrl_pass(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, s: LanguageSettings) -> None:
    """One pass over (label, buckets, values), in place. The last row of z and n is the bias."""
    for label, at, values in rows:
        w = _weights(z[at], n[at], s)
        p = _softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
        z[at] += g - sigma * w
        n[at] += g * g


def _cut(values: np.ndarray) -> list[bytes]:
    return [values[at : at + _SLICE].tobytes() for at in range(0, len(values), _SLICE)]


def _laid(slices: pd.DataFrame, column: str, shape: tuple[int, int]) -> np.ndarray:
    """The slices one behind another, zeros where there is none."""
    out = np.zeros(shape)
    for k, values in zip(slices["slice"], slices[column], strict=True):
        out[k * _SLICE : (k + 1) * _SLICE] = np.frombuffer(values).reshape(-1, shape[1])
    return out


def _shard_pass(idf: np.ndarray, shape: tuple[int, int], s: LanguageSettings):
    def one_pass(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        """A shard's state after its rows; the state before them is zero in the first pass."""
        if not len(frame):
            return pd.DataFrame({"shard": [], "slice": [], "z": [], "n": []})
        shard = int(frame["shard"].iloc[0])
        frame = frame.sort_values(["u", "label"])
        z, n = (_laid(state, c, shape) for c in ("z", "n"))
        rows = []
        for label, a, v in zip(frame["label"], frame["at"], frame["tf"], strict=True):
            at = np.frombuffer(a, np.int64)
            values = _weighted(at, np.frombuffer(v), idf)
            rows.append((label, np.append(at, shape[0] - 1), np.append(values, 1.0)))
        _ftrl_pass(rows, z, n, s)
        z, n = _cut(z), _cut(n)
        return pd.DataFrame({"shard": shard, "slice": range(len(z)), "z": z, "n": n})

    return one_pass


def _mean_of_shards(found: pd.DataFrame) -> pd.DataFrame:
    found = found.sort_values("shard")
    mean = {c: [np.mean([np.frombuffer(x) for x in found[c]], axis=0).tobytes()] for c in ("z", "n")}
    return pd.DataFrame({"slice": found["slice"].iloc[:1].to_numpy(), **mean})


def _final_weights(state: DataFrame, shape: tuple[int, int], s: LanguageSettings) -> np.ndarray:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = [_weights(np.frombuffer(z), np.frombuffer(n), s).tobytes() for z, n in zip(frame["z"], frame["n"], strict=True)]
            yield pd.DataFrame({"slice": frame["slice"], "w": w})

    # As many numbers as the model holds.
    rows = [(r["slice"], r["w"]) for r in state.mapInPandas(run, "slice int, w binary").collect()]
    return _laid(pd.DataFrame(rows, columns=["slice", "w"]), "w", shape)


def sample(docs: DataFrame, text: str, lang: str, settings: LanguageSettings) -> DataFrame:
    """(label, text, u): labelled rows with text, about as many of each language; u is their place in [0, 1)."""
    u = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("text")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("label"), F.col(text).alias("text"))
    rates = rows.groupBy("label").count().select(F.col("label").alias("_l"), (F.lit(float(settings.rows_per_language)) / F.col("count")).alias("rate"))
    # One row a language, and languages are label values: far below any broadcast limit.
    return rows.withColumn("u", u.alias("u")).join(F.broadcast(rates), F.col("label") == F.col("_l")).where("u < rate").select("label", "text", (F.col("u") / F.least("rate", F.lit(1.0))).alias("u"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Learns from rows with text and language; without any, the model knows no language."""
    spark, s = docs.sparkSession, settings
    chosen = written(sample(docs, text, lang, s), "language_rows")
    languages = sorted(r[0] for r in chosen.select("label").distinct().collect())
    if not languages:
        return LanguageModel([], np.zeros((s.buckets, 0)), np.zeros(0), np.zeros(s.buckets), 1.0, s)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            terms = [_terms(t, s.buckets) for t in frame["text"]]
            yield pd.DataFrame(
                {"label": [languages.index(x) for x in frame["label"]], "u": frame["u"], "at": [a.tobytes() for a, _ in terms], "tf": [v.tobytes() for _, v in terms]}
            )

    made = written(chosen.repartition(s.shards * 2, "u").mapInPandas(features, "label int, u double, at binary, tf binary"), "language_features")
    train = made.where("u >= 0.2 or u < 0")
    n_docs = max(train.count(), 1)

    def document_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(s.buckets, np.int64)
        for frame in frames:
            for a in frame["at"]:
                total[np.frombuffer(a, np.int64)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "df": total[at]})

    df = np.zeros(s.buckets)
    counted = train.mapInPandas(document_counts, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column("bucket").to_numpy()] = counted.column("df").to_numpy()
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    shape = (s.buckets + 1, len(languages))
    # No rows, and none that a Python worker of their own would have to make.
    state = spark.range(0).selectExpr("cast(id as int) as slice", "cast(null as binary) as z", "cast(null as binary) as n")
    sharded = train.withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(s.shards)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(s.shards - 1))).alias("shard")
    for _ in range(s.passes):
        # A shard holds a bounded share of the bounded sample; its state has a fixed size.
        before = state.select("*", every).groupBy("shard")
        after = sharded.groupBy("shard").cogroup(before).applyInPandas(_shard_pass(idf, shape, s), f"shard int, {_STATE}")
        state = written(after.groupBy("slice").applyInPandas(_mean_of_shards, _STATE), "language_state")
    w = _final_weights(state, shape, s)
    model = LanguageModel(languages, w[:-1], w[-1], idf, 1.0, s)
    return LanguageModel(languages, w[:-1], w[-1], idf, _temperature(made.where("u >= 0 and u < 0.2"), model), s)


def _logits(at: np.ndarray, tf: np.ndarray, m: LanguageModel) -> np.ndarray:
    return _weighted(at, tf, m.idf) @ m.weights[at] + m.bias


def _broadcast(df: DataFrame, m: LanguageModel):
    """Plain arrays: workers need no copy of this package to read them."""
    return df.sparkSession.sparkContext.broadcast((m.languages, m.weights, m.bias, m.idf, m.temperature))


def _temperature(rows: DataFrame, model: LanguageModel) -> float:
    """The divisor of the logits with the least loss on the kept-out rows; 1 if there are none."""
    plain, settings = _broadcast(rows, model), model.settings

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*plain.value, settings)
        for frame in frames:
            found = [_logits(np.frombuffer(a, np.int64), np.frombuffer(v), m) for a, v in zip(frame["at"], frame["tf"], strict=True)]
            yield pd.DataFrame({"label": frame["label"], "logits": [x.tobytes() for x in found]})

    held = rows.mapInPandas(run, "label int, logits binary").collect()  # part of the bounded sample
    plain.destroy()
    if not held:
        return 1.0
    logits = np.array([np.frombuffer(r["logits"]) for r in held])
    label = np.array([r["label"] for r in held])

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean()

    low, high = np.log(0.5), np.log(20.0)  # rows without any error would draw it towards 0
    for _ in range(60):  # the loss has one minimum in 1 / t
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns with ``lang_pred`` and ``score``, replacing columns of these names.

    ``und`` and 0 if the text is null or has no letter, or if the model knows
    no language. Ties go to the first language by name. Whole texts are read;
    only the text decides.
    """
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    plain, settings = _broadcast(docs, model), model.settings

    def one(t: str | None, m: LanguageModel) -> tuple[str, float]:
        at, tf = _terms(t, settings.buckets)
        if not len(at) or not m.languages:
            return UNKNOWN, 0.0
        p = _softmax(_logits(at, tf, m) / m.temperature)
        best = int(p.argmax())
        return m.languages[best], float(p[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*plain.value, settings)
        for b in slices(batches):
            found = [one(t, m) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = pa.schema([*b.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], schema=names)

    return base.mapInArrow(run, schema)


def training_rows(key: Column) -> Column:
    return fold(key) != 0
