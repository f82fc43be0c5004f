"""Rows against more centres than a task may hold: blocks of rows meet blocks of centres.

Every block of rows goes to one task for each block of centres, which gives one partial result a row; partial
results are merged by Spark's aggregation. A task holds two blocks, whatever the number of rows or centres, and
no centre reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectroloom.operators import matrix as M

#: Partial results of a block of rows against a block of centres: (row matrix, rows' table, centre matrix, centres' table) to columns.
Partial = Callable[[np.ndarray, pa.Table, np.ndarray, pa.Table], dict[str, pa.Array]]

#: Types of columns that blocks carry.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


#: Values of a block of rows; together with a block of centres, what a task holds.
ROW_VALUES = 1 << 20


def in_blocks(rows: DataFrame, centres: DataFrame, dimensions: int, n_centres: int, keep: list[str], partial: Partial, schema: str, merge: list[Column], with_x: bool = False, most: int | None = None) -> DataFrame:
    """``keep`` (and ``x``, if asked for) and the merged columns for every row of ``rows``.

    ``rows`` has ``x`` and the columns ``keep``; ``centres`` has ``centre`` and any others. ``partial`` gives the
    columns of ``schema``, which ``merge`` aggregates over the blocks of centres (they also see ``centre_block``).
    ``most`` is what a task may hold of centres, MAX_BROADCAST_VALUES unless given; blocks are half of it.
    Equal rows are worked on once and given back as often as they came, so copies cannot overfill a block.
    """
    size, row_size = (max(1, v // max(dimensions, 1)) for v in ((M.MAX_BROADCAST_VALUES if most is None else most) // 2, ROW_VALUES))
    n_blocks = -(-n_centres // size)
    copies = rows.groupBy(*keep, "x").agg(F.count("*").alias("copies"))
    n_rows = copies.count()
    row_blocks = max(1, -(-n_rows // row_size))
    row_blocks, n_blocks = (2 * b if b > 1 else 1 for b in (row_blocks, n_blocks))  # by hash, so half full on average
    place = Window.partitionBy("row_block").orderBy(*keep, "x")
    left = copies.withColumn("row_block", F.pmod(F.xxhash64(*keep, "x"), F.lit(row_blocks)).cast("int")).withColumn("place", F.row_number().over(place))
    left = left.withColumn("centre_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = centres.withColumn("centre_block", F.pmod(F.xxhash64(*[c for c in centres.columns if c != "centre"]), F.lit(n_blocks)).cast("int"))
    right = right.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    keys, carried = ["row_block", "centre_block"], [*keep, *["x"] * with_x, "row_block", "place", "copies", "centre_block"]
    types = {**{c: dict(left.dtypes)[c] for c in carried}, **dict(f.strip().split(" ", 1) for f in schema.split(","))}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:  # a block without rows has no columns either
            return pa.table({c: pa.nulls(0, ARROW[t]) for c, t in types.items()})
        found = partial(M.matrix(a.column("x").combine_chunks(), dimensions), a, M.matrix(b.column("centre").combine_chunks(), dimensions), b)
        table = a.select(carried)
        for name, values in found.items():
            table = table.append_column(name, values)
        return table

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ", ".join(f"`{c}` {t}" for c, t in types.items()))
    merged = met.groupBy(*keep, *["x"] * with_x, "row_block", "place", "copies").agg(*merge)
    return merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("row_block", "place", "copies", "_copy")


def best(similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each row and the first place that has it; minus infinity without columns."""
    n, k = similarity.shape
    if not n or not k:
        return np.full(n, -np.inf), np.zeros(n, np.int64)
    at = similarity.argmax(1)
    return similarity[np.arange(n), at], at
