"""Embeddings as whole numbers, so that distances, sums and ties are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and has neither a null nor a non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def whole(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """The rows with a finite vector, whose components are floor(scale * component) in x.

    A row so far from zero that a squared distance might not fit 64 bits is an error: no exact answer exists for it."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    most = F.array_max(F.transform(vector, lambda c: F.abs(c.cast("double")))) * scale + 1
    fits = F.coalesce(4 * most * most * F.size(vector) < F.lit(2.0**63), F.lit(True))
    return rows.where(finite(vector)).withColumn("x", F.when(fits, x).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances"))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of an Arrow column of lists of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def sums_by(near: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows chose each of k entries, and the exact sums of those rows."""
    chosen = (near[None, :] == np.arange(k)[:, None]).astype(np.int64)
    return chosen.sum(1), chosen @ x
