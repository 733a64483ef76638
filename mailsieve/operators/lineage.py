"""Cutting lineage, shared scratch paths and joins with small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Folders of the flows that run, innermost last; the folder of a local session without the setting.
_run_folders: list[str] = []
_local_folders: list[str] = []


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local master, as in tests, gets a temporary folder where the setting
    is missing; it goes when Python ends. A cluster session is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_folders:
        _local_folders.append(tempfile.mkdtemp(prefix="mailsieve-"))
        atexit.register(shutil.rmtree, _local_folders[0], ignore_errors=True)
    return _local_folders[0]


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Scratch tables written inside go to one folder, which is deleted at the end.

    For flows whose result is written elsewhere. Flows may nest.
    """
    path = f"{_shared_folder(spark)}/mailsieve/{uuid.uuid4().hex}"
    _run_folders.append(path)
    try:
        yield path
    finally:
        _run_folders.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the flow's folder, or else under the shared folder."""
    folder = _run_folders[-1] if _run_folders else f"{_shared_folder(spark)}/mailsieve"
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values as JSON: what a broadcast of the frame would be, roughly; one number a task."""
    width = F.octet_length(F.to_json(F.struct(*df.columns))) + 32
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).head()[0]


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "left",
    broadcast_bytes: int = 8 << 20,
    hot_rows: int = 1_000_000,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join rows with a table that holds each key once, whatever the skew of the key.

    A table of at most ``broadcast_bytes`` is broadcast. A larger one is joined
    by shuffle; a key with more than ``hot_rows`` rows is spread over count /
    ``hot_rows`` tasks and its table row copied that often. ``bound`` is a
    frame with no fewer bytes than the table that is cheaper to measure.
    """
    if measured_bytes(table if bound is None else bound) <= broadcast_bytes:
        return rows.join(F.broadcast(table), key, how)
    counts = rows.groupBy(key).count().where(F.col("count") > hot_rows)
    hot = settle(counts.select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts")))
    if hot.isEmpty():
        return rows.join(table, key, how)
    if measured_bytes(hot) <= broadcast_bytes:
        hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
    copies = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")
