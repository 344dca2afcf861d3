"""Vectors as integers, shared by clustering and coding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components lie below this, so that squared distances of up to 64 of them fit a long.
MAGNITUDE = 1 << 27


def integer_vectors(table: DataFrame, scale: int, dims: int, *columns: str, vector_col: str = "embedding") -> DataFrame:
    """The given columns and ``v``, the vector's components x as floor(scale * x), x as double.

    Left out are null vectors, vectors of other lengths than ``dims`` and those with a null or non-finite
    component. A component of 2^27 or more after scaling raises, as its distances don't fit a long.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    small = F.forall(x, lambda c: F.abs(c * scale) < MAGNITUDE)
    whole = F.transform(x, lambda c: F.floor(c * scale))
    kept = table.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & finite)
    return kept.select(*columns, F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) int64 of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)
