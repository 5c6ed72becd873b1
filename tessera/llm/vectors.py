"""Vectors of integers: exact in tables, matrices of 64-bit integers in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this sums of products are exact in doubles, below the next in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**63


def whole(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    xs = F.col(column).cast("array<double>")
    return xs.isNotNull() & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: DataFrame, column: str, scale: int, *others: Column) -> DataFrame:
    """(others, vec array<long>): floor(scale * x) of the whole vectors; a component that 64 bits can't hold is an error."""
    times = lambda x: x * F.lit(float(scale))
    floor = lambda x: F.when(F.abs(times(x)) < 2.0**63, F.floor(times(x))).otherwise(F.raise_error(F.lit("a component times the scale does not fit 64 bits")).cast("long"))
    return vectors.filter(whole(column)).select(*others, F.transform(F.col(column).cast("array<double>"), floor).alias("vec"))


def matrix(cells: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """One row a vector; missing components are 0."""
    if isinstance(cells, pa.ChunkedArray):
        cells = pa.concat_arrays(cells.chunks) if cells.num_chunks else pa.array([], cells.type)
    flat, lengths = cells.flatten().to_numpy(zero_copy_only=False), cells.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows.astype(float)).sum(axis=1))
