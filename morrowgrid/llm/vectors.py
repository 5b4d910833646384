"""Integer vectors, as the exact clustering and compression of vectors use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import named

#: Components are floor(SCALE * x), kept between -LIMIT and LIMIT: squared distances of up to 64 of them then fit in a long.
SCALE, LIMIT = 256, 1 << 27


def finite(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector is there, has `dim` components (if given) and none that is null or not finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & (F.size(vector) == dim if dim else F.lit(True)), F.lit(False))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int | None = None, label_col: str | None = None, scale: int = SCALE) -> DataFrame:
    """(id, x[, label]) of the rows with a finite vector (of `dim` components): x holds floor(scale * component).

    A component beyond LIMIT counts as LIMIT, of either sign. Only these columns are read, whatever else df has.
    """
    vector = named(vector_col).cast("array<double>")
    whole = F.transform(vector, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    label = [named(label_col).alias("label")] if label_col else []
    return df.where(finite(vector, dim)).select(named(id_col).alias("id"), whole.alias("x"), *label)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column of `dim` integers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in floating point where all sums stay below 2**53, else in 64-bit integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def summed(df: DataFrame, key: str, width: int) -> list:
    """Rows (key, n long, sums array<long> of `width`) added up by key, as exact decimals; the caller bounds the number of keys."""
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return df.groupBy(key).agg(F.sum("n").alias("n"), *total).collect()


def as_long(total: int) -> int | None:
    """A sum as a long; null if it doesn't fit in one."""
    return total if total < 2**63 else None
