"""Rows that hold a vector: which ones count, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """True where the vector is there and all its entries are finite numbers; never null."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(sound, F.lit(False))


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Lists of one length without nulls as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)
