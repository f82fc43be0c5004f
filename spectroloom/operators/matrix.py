"""Arrow batches of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of centroids (rows x dimensions) that may be sent to every task; beyond, work goes block by block.
MAX_BROADCAST_VALUES = 1 << 24


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of one length (``width``, if given) as a matrix; an error for null rows, null values and other lengths."""
    n = len(column)
    if column.null_count or (flat := column.flatten()).null_count:
        raise ValueError("vectors must not be null or hold nulls")
    values, sizes = np.asarray(flat, dtype=np.float64), np.asarray(column.value_lengths())
    d = width if width is not None else int(sizes[0]) if n else 0
    if (sizes != d).any():
        raise ValueError(f"vectors have {sorted(set(sizes.tolist()))[:3]} values, {d} are wanted")
    return values.reshape(n, d)


def usable(column: pa.Array) -> np.ndarray:
    """Which rows are neither null nor hold a null or a non-finite value."""
    good = np.asarray(pc.is_valid(column)).copy()
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    bad = np.asarray(flat.is_null()) | ~np.isfinite(np.asarray(flat.fill_null(0.0), dtype=np.float64))
    good[row[bad]] = False
    return good


def usable_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(good, rows)``: which rows are usable, and those as a matrix; a usable row of another length is an error."""
    good = usable(column)
    return good, matrix(column if good.all() else column.filter(pa.array(good)), width)


def spread(good: np.ndarray, values: pa.Array) -> pa.Array:
    """Values of the usable rows at their places, nulls at the others."""
    if good.all():
        return values
    return values.take(pa.array(np.where(good, np.cumsum(good) - 1, 0), mask=~good))


def lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d or 1, dtype=np.int32)[: n + 1] if d else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def unit(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), eps)


def vectors(df: DataFrame, row_id: str, x: str) -> DataFrame:
    """``(row_id, x)`` as long and array of doubles."""
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.col(x).cast("array<double>").alias("x"))


def validate(df: DataFrame, x: str = "x", least: int = 1) -> int | None:
    """The common length of the rows, or none if there are fewer than ``least``; an error if lengths differ, or for empty rows, NULL, NaN or infinity."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    r = df.agg(F.count("*").alias("n"), F.min(F.size(x)).alias("lo"), F.max(F.size(x)).alias("hi"), F.coalesce(F.max((F.col(x).isNull() | bad).cast("int")), F.lit(0)).alias("bad")).first()
    if r["n"] == 0:
        raise ValueError("no rows")
    if r["bad"] or r["lo"] != r["hi"] or r["lo"] < 1:
        raise ValueError("vectors must be finite and of one length")
    return r["lo"] if r["n"] >= least else None


def fits(rows: int, dimensions: int, most: int | None = None) -> bool:
    """Whether so many centroids may be sent to every task, which may hold ``most`` values."""
    return rows * dimensions <= (MAX_BROADCAST_VALUES if most is None else most)


def check_broadcast(rows: int, dimensions: int) -> None:
    if not fits(rows, dimensions):
        raise ValueError(f"{rows} x {dimensions} values are more than {MAX_BROADCAST_VALUES} for one task")
