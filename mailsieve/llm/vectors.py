"""What vector operators share: which vectors take part, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of one length as doubles."""
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def block(row: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")
