"""Embedding vectors as integers, in Spark and as numpy arrays in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component x counts as floor(SCALE * x). From LARGEST on, squared distances and products of 64 components may not fit a long.
SCALE, LARGEST = 256, 1 << 19


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """id, x: vectors with no null or non-finite component, as integers; only those of dim components, or all but the empty ones.

    A component of LARGEST or more in size stops the run with a message: no result in longs is right for it.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    huge = F.raise_error(F.lit(f"a vector has a component of {LARGEST} or more in size: its distances don't fit a long"))
    size = F.size(v) == dim if dim else F.size(v) > 0
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(v.isNotNull() & size & finite)
    return kept.select("id", F.when(F.exists(v, lambda x: F.abs(x) >= LARGEST), huge).otherwise(whole).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel()).cast(kind))
