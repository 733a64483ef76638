"""Source files to splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsieve.operators.conform import number_rows
from mailsieve.operators.dedup import dedup_text
from mailsieve.operators.lineage import run_folder, stored
from mailsieve.operators.split import manifest, stratified_split
from mailsieve.sources.files import read_sources, write_manifest, write_splits


def prepare(
    spark: SparkSession, sources: str, out: str, seed: int = 42, val_frac: float = 0.1,
    test_frac: float = 0.1, strict: bool = True,
) -> DataFrame:
    """Reads, deduplicates, splits and writes; gives the manifest of what was written.

    Rows are numbered in file order, so that the first of equal texts is found by
    the smallest number, a fixed-width aggregate. The deduplicated messages are written once before the split looks at them,
    as the split reads them several times, mostly by narrow columns.
    """
    with run_folder(spark):
        numbered = number_rows(read_sources(spark, sources)).drop("_file", "_row")
        messages = dedup_text(numbered, ("_n",)).drop("_n")
        messages.write.mode("overwrite").parquet(f"{out}/messages")
        unique = spark.read.parquet(f"{out}/messages")
        split = stratified_split(unique, seed, val_frac, test_frac, strict=strict)
        write_splits(split, f"{out}/splits")
    with run_folder(spark):
        found = stored(manifest(spark.read.parquet(f"{out}/splits")), "manifest")
        write_manifest(found, f"{out}/manifest", seed)
        rows = found.collect()  # a row a split
    return spark.createDataFrame(rows, found.schema)
