"""Any labelled text table as canonical messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mailsieve.constants import CANONICAL, LEGITIMATE, MESSAGE_SCHEMA, PHISH
from mailsieve.operators.lineage import lookup, settle


def require_columns(
    df: DataFrame, required: Sequence[str] = CANONICAL, where: str = "input"
) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{where} misses columns: {', '.join(missing)}")
    return df


def check_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Fails the job on a label outside the domain."""
    value = F.col(label)
    message = F.concat(F.lit("label outside 0 and 1: "), F.coalesce(value.cast("string"), F.lit("null")))
    checked = F.when(value.isin(LEGITIMATE, PHISH), value).otherwise(F.raise_error(message).cast("int"))
    return df.withColumn(label, checked)


def canonical_only(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Canonical columns in order and type, and the extra ones; others are dropped."""
    require_columns(df)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE_SCHEMA]
    return df.select(*typed, *extra)


def conform(
    df: DataFrame,
    renames: Mapping[str, str] | None = None,
    constants: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rename, add constant columns, cast, check labels, project."""
    df = df.withColumnsRenamed(dict(renames or {}))
    literal = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (constants or {}).items()}
    if literal:
        df = df.withColumns(literal)
    return check_labels(canonical_only(df))


def number_rows(
    df: DataFrame, out: str = "_n", file: str = "_file", row: str = "_row"
) -> DataFrame:
    """Adds 0..n-1 in file order: the rows of the files before, plus the row within the file.

    Only one row a file is ever ordered globally.
    """
    lengths = df.groupBy(file).agg((F.max(row) + 1).alias("_rows"))
    before = W.orderBy(file).rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        lengths.select(file, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    placed = lookup(df, offsets, file, spread_by=F.col(row), how="inner")
    return placed.select(*df.columns, (F.col("_offset") + F.col(row)).alias(out))


def assign_ids(
    df: DataFrame, prefix: str, file: str = "_file", row: str = "_row", dense: bool = False
) -> DataFrame:
    """Row ids from the place in the source files: file and row, or a dense number."""
    if dense:
        numbered = number_rows(df, "_n", file, row)
        return numbered.withColumn("id", F.concat_ws("_", F.lit(prefix), F.col("_n"))).drop("_n")
    return df.withColumn("id", F.concat_ws("_", F.lit(prefix), F.col(file), F.col(row)))
