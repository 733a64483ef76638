"""Reading and writing the tables that flows pass to each other."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsieve.constants import CANONICAL
from mailsieve.operators.conform import canonical_only, require_columns

SPLITS = ("train", "val", "test")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop_path(spark, path)
    return fs.exists(where)


def source_names(spark: SparkSession, folder: str) -> list[str]:
    """Names ending in .parquet in the folder, files or tables, in byte order."""
    where, fs = _hadoop_path(spark, folder)
    if not fs.exists(where):
        raise FileNotFoundError(f"no source folder: {folder}")
    names = [entry.getPath().getName() for entry in fs.listStatus(where)]
    found = sorted((n for n in names if n.endswith(".parquet")), key=lambda n: n.encode())
    if not found:
        raise RuntimeError(f"no parquet sources in {folder}")
    return found


def _places(spark: SparkSession, folder: str) -> Column:
    """A row's file below the folder, with all sub-folders, so that no two files share a place."""
    where, fs = _hadoop_path(spark, folder)
    root = f"{fs.makeQualified(where).toUri().getRawPath().rstrip('/')}/"
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    below = F.substring(path, len(root) + 1, 1 << 30)
    return F.when(F.startswith(path, F.lit(root)), below).otherwise(path)


def _one_schema(spark: SparkSession, folder: str, names: list[str]) -> list[list[str]]:
    """The sources grouped so that each group can be read as one table.

    Sources with partition folders stay alone: their columns come from their
    own folder names. Footers are read side by side.
    """
    def shape(name: str) -> tuple[str, str]:
        where, fs = _hadoop_path(spark, f"{folder}/{name}")
        alone = fs.getFileStatus(where).isDirectory() and any(
            "=" in entry.getPath().getName() for entry in fs.listStatus(where)
        )
        schema = require_columns(spark.read.parquet(f"{folder}/{name}"), CANONICAL, name).schema
        return name if alone else "", schema.json()

    groups: dict[tuple[str, str], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for name, key in zip(names, pool.map(inheritable_thread_target(spark)(shape), names), strict=True):
            groups.setdefault(key, []).append(name)
    return list(groups.values())


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All sources of a folder as canonical messages.

    Sources of one schema are one scan, however many they are; columns are
    checked and cast schema by schema. ``_file`` and ``_row`` keep the place of
    a row: the path of its file below the folder, which begins with the
    source's name, and the row of the file.
    """
    place, parts = _places(spark, folder), []
    for names in _one_schema(spark, folder, source_names(spark, folder)):
        table = spark.read.parquet(*[f"{folder}/{name}" for name in names])
        placed = table.select(
            *CANONICAL, place.alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
        parts.append(canonical_only(placed, extra=("_file", "_row")))
    return reduce(DataFrame.unionByName, parts)


def write_source(messages: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    canonical_only(messages).write.mode(mode).parquet(f"{folder}/{name}.parquet")


def write_splits(split: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """One table partitioned by split."""
    split.write.mode(mode).partitionBy("split").parquet(folder)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split; only its partition is listed and read."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    return spark.read.parquet(folder).where(F.col("split") == split).drop("split")


def write_probs(scored: DataFrame, folder: str, split: str, mode: str = "overwrite") -> None:
    scored.select("id", "channel", "label", "prob_phish").write.mode(mode).parquet(
        f"{folder}/{split}_probs.parquet"
    )


def read_probs(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{split}_probs.parquet")


def _write_json(rows: DataFrame, path: str, mode: str) -> None:
    rows.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_manifest(manifest: DataFrame, path: str, seed: int, mode: str = "overwrite") -> None:
    """One nested object: seed, and the statistics of every split by name."""
    facts = F.struct("rows", "n_phish", "n_email", "n_sms", "sha256")
    splits = F.map_from_entries(F.collect_list(F.struct("split", facts)))
    _write_json(manifest.agg(F.lit(seed).alias("seed"), splits.alias("splits")), path, mode)


def write_metrics(
    metrics: DataFrame, path: str, config: dict, seed: int, fit_seconds: float,
    mode: str = "overwrite",
) -> None:
    """One nested object: config, seed, fit seconds, and the metrics of every split."""
    facts = F.struct(*[c for c in metrics.columns if c != "split"])
    splits = F.map_from_entries(F.collect_list(F.struct("split", facts)))
    text = json.dumps(config, default=str, ensure_ascii=False)
    nested = metrics.agg(
        F.parse_json(F.lit(text)).alias("config"),
        F.lit(seed).alias("seed"),
        F.lit(float(fit_seconds)).alias("fit_seconds"),
        splits.alias("splits"),
    )
    _write_json(nested, path, mode)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write_json(report, path, mode)


def show_report(report: DataFrame) -> None:
    """Prints the report with four decimals."""
    shown = [
        F.format_number(c, 4).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes
    ]
    report.select(*shown).show(truncate=False)
