"""Weighted logistic regression over TF-IDF weights and cues."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mailsieve.constants import CUE_NAMES
from mailsieve.functions.cues import Lexicons, extract_cues
from mailsieve.functions.text import unicode_forms
from mailsieve.operators.lineage import scratch_path, stored
from mailsieve.operators.tfidf import (
    TfidfSettings, build_vocabulary, index_terms, message_words, weigh_terms,
)


@dataclass(frozen=True)
class LinearSettings:
    tfidf: TfidfSettings = field(default_factory=TfidfSettings)
    use_cues: bool = True
    cue_names: Sequence[str] = CUE_NAMES
    lexicons: Lexicons = field(default_factory=Lexicons)
    C: float = 1.0
    max_iter: int = 1000
    class_weight: str | None = "balanced"
    tol: float = 1e-6

    @property
    def cues(self) -> tuple[str, ...]:
        return tuple(self.cue_names) if self.use_cues else ()


@dataclass(frozen=True)
class LinearModel:
    """``terms``: (term, idf, weight), a row a vocabulary term; ``cues``: weight by name."""

    terms: DataFrame
    cues: dict[str, float]
    intercept: float
    settings: LinearSettings


def with_features(
    messages: DataFrame, keep: Sequence[str], settings: LinearSettings, text: str = "text"
) -> DataFrame:
    """The kept columns, the cues and the words of every message."""
    if not settings.use_cues:
        return message_words(messages, keep, text)
    formed = messages.withColumn("_forms", unicode_forms(text))
    cued = extract_cues(formed, text, settings.cues, settings.lexicons, F.col("_forms.nfkc"))
    return message_words(cued, [*keep, *settings.cues], text, F.col("_forms.fold"))


def assemble_features(
    featured: DataFrame, vocabulary: DataFrame, settings: LinearSettings, key: str = "id"
) -> DataFrame:
    """Long table (id, feature, value): unit-length TF-IDF rows beside raw non-zero cues, from one pass."""
    weighed = weigh_terms(featured, vocabulary, settings.tfidf)
    pairs = F.transform("weights", lambda w: F.struct(F.concat(F.lit("term="), w["term"]).alias("feature"), w["value"].alias("value")))
    if settings.cues:
        cues = F.array(*[
            F.struct(F.lit(f"cue={c}").alias("feature"), F.col(c).cast("double").alias("value"))
            for c in settings.cues
        ])
        pairs = F.concat(pairs, F.filter(cues, lambda p: p["value"] != 0))
    rows = weighed.select(key, F.explode_outer(pairs).alias("_p")).where("_p is not null")
    return rows.select(key, "_p.*")


def _training_vectors(
    featured: DataFrame, vocabulary: DataFrame, size: int, settings: LinearSettings
) -> DataFrame:
    """(label, features) with sparse vectors, a row a message.

    The parts of a sparse vector are written as plain columns and read back
    under the vector type. The written table also means that a lost executor
    costs a read, not the featurizing.
    """
    rows = weigh_terms(featured, vocabulary, settings.tfidf)
    entries = F.sort_array(F.transform("weights", lambda w: F.struct(w["index"].alias("index"), w["value"].alias("value"))))
    rows = rows.withColumn("_entries", entries)
    indices, values = F.col("_entries.index"), F.col("_entries.value")
    if settings.cues:
        places = F.array(*[F.lit(size + i) for i in range(len(settings.cues))])
        indices = F.concat(indices, places)
        values = F.concat(values, F.array(*[F.col(c).cast("double") for c in settings.cues]))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size + len(settings.cues)).alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )
    path = scratch_path(featured.sparkSession, "vectors")
    rows.select(F.col("label").cast("double").alias("label"), vector.alias("features")).write.parquet(path)
    schema = T.StructType(
        [T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]
    )
    return featured.sparkSession.read.schema(schema).parquet(path)


def fit_lr(vectors: DataFrame, settings: LinearSettings):
    """Penalized as 0.5 |w|^2 + C * sum(weight * loss), with a free intercept."""
    counts = vectors.agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    ).head()
    if not counts["pos"] or not counts["neg"]:
        raise ValueError("both labels are needed to fit")
    rows = counts["pos"] + counts["neg"]
    if settings.class_weight == "balanced":
        pos, neg = rows / (2.0 * counts["pos"]), rows / (2.0 * counts["neg"])
    elif settings.class_weight is None:
        pos = neg = 1.0
    else:
        raise ValueError(f"unknown class_weight: {settings.class_weight}")
    weighted = vectors.withColumn("_weight", F.when(F.col("label") == 1, pos).otherwise(neg))
    total = pos * counts["pos"] + neg * counts["neg"]
    return LogisticRegression(
        weightCol="_weight",
        regParam=1.0 / (settings.C * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=settings.max_iter,
        tol=settings.tol,
        family="binomial",
    ).fit(weighted)


def fit_text_classifier(
    train: DataFrame, settings: LinearSettings = LinearSettings(), text: str = "text",
    label: str = "label", partitions: int | None = None,
) -> LinearModel:
    """Vocabulary and idf of the training rows, then the regression.

    ``max_features`` must be set: it bounds what is broadcast and what the
    driver holds of the weights. ``partitions`` deals the rows out anew, for
    input in fewer files than there are cores.
    """
    spark = train.sparkSession
    if settings.tfidf.max_features is None:
        raise ValueError("max_features must be set to fit")
    train = train.withColumnRenamed(label, "label") if label != "label" else train
    train = train.repartition(partitions) if partitions else train
    # Both readers of the featurized rows, the vocabulary and the vectors, start from the table.
    featured = stored(with_features(train, ["label"], settings, text), "featured")
    vocabulary = stored(index_terms(build_vocabulary(featured.select("terms"), settings.tfidf)), "vocabulary")
    size = vocabulary.count()
    if size == 0:
        raise ValueError("no terms remain; lower min_df or raise max_df")
    vectors = _training_vectors(featured, vocabulary, size, settings)
    fitted = fit_lr(vectors, settings)
    weights = fitted.coefficients.toArray()
    table = spark.createDataFrame(
        pa.table({"index": pa.array(range(size), pa.int32()), "weight": weights[:size]})
    )
    terms = stored(
        vocabulary.join(table, "index").select("term", "df", "idf", "weight"), "model_terms"
    )
    cues = {name: float(w) for name, w in zip(settings.cues, weights[size:], strict=True)}
    return LinearModel(terms, cues, float(fitted.intercept), settings)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _cue_part(model: LinearModel) -> Column:
    total = F.lit(model.intercept)
    for name, weight in model.cues.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def score(
    messages: DataFrame, model: LinearModel, keep: Sequence[str] = ("id", "channel", "label"),
    text: str = "text",
) -> DataFrame:
    """The kept columns and ``prob_phish``, a row for every message, whatever its keys.

    Nothing leaves its row: the terms meet the model in an Arrow pass. A
    message without any known term is scored by cues and intercept.
    """
    settings = model.settings
    featured = with_features(messages, keep, settings, text).select(
        *keep, _cue_part(model).alias("_base"), "terms"
    )
    weighed = weigh_terms(featured, model.terms.select("term", "idf", "weight"), settings.tfidf)
    return weighed.select(*keep, sigmoid(F.col("_base") + F.col("dot")).alias("prob_phish"))


def predict_proba(
    messages: DataFrame, model: LinearModel, keep: Sequence[str] = ("id",), text: str = "text"
) -> DataFrame:
    """Probabilities of both classes as an array, legitimate first."""
    p = F.col("prob_phish")
    return score(messages, model, keep, text).select(*keep, F.array(1 - p, p).alias("probabilities"))


def explain_model(model: LinearModel) -> DataFrame:
    """(feature, kind, weight), largest absolute weight first."""
    terms = model.terms.select(F.col("term").alias("feature"), F.lit("term").alias("kind"), "weight")
    if model.cues:
        cues = terms.sparkSession.createDataFrame(
            [(name, "cue", weight) for name, weight in model.cues.items()], terms.schema
        )
        terms = terms.unionByName(cues)
    return terms.orderBy(F.desc(F.abs("weight")), "feature")


def save_model(model: LinearModel, path: str, mode: str = "overwrite") -> None:
    """Term table as parquet, everything else as one JSON row."""
    spark = model.terms.sparkSession
    model.terms.write.mode(mode).parquet(f"{path}/terms")
    state = {"cues": model.cues, "intercept": model.intercept, "settings": asdict(model.settings)}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode(mode).text(
        f"{path}/state"
    )


def load_model(spark: SparkSession, path: str) -> LinearModel:
    state = json.loads(spark.read.text(f"{path}/state").head()[0])
    settings = state["settings"]
    settings["tfidf"] = TfidfSettings(**settings["tfidf"])
    settings["lexicons"] = Lexicons(**settings["lexicons"])
    return LinearModel(
        spark.read.parquet(f"{path}/terms"), state["cues"], state["intercept"],
        LinearSettings(**settings),
    )
