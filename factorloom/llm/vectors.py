"""What the operators on embedding vectors share: which rows take part, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINITE = 1.7976931348623157e308


def entries(vec: str) -> Column:
    """The vector as doubles, -0.0 as 0.0."""
    return F.transform(F.col(vec), lambda x: x.cast("double") + F.lit(0.0))


def usable(vec: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(F.forall(F.col(vec), lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(FINITE), F.lit(False))), F.lit(False))


def width(df: DataFrame, vec: str) -> int:
    """Length of the longest vector."""
    return df.agg(F.coalesce(F.max(F.size(vec)), F.lit(0))).first()[0]


def matrix(column: pa.ChunkedArray | pa.Array, columns: int, dtype=np.float64) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(one, pa.ChunkedArray):
        one = pa.concat_arrays(one.chunks)
    flat, n = one.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), len(one)
    if len(flat) == n * columns:
        return flat.reshape(n, columns)
    out, sizes = np.zeros((n, columns), dtype), one.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lists(m: np.ndarray, dtype: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    n, columns = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * columns), pa.array(np.ascontiguousarray(m).reshape(-1), dtype))
