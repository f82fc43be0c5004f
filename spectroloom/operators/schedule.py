"""Learning-rate schedule and moving averages as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warmup_cosine(step: Column, warmup_steps: Column | int, total_steps: Column | int, min_lr_scale: float = 0.1) -> Column:
    """The multiplier of a step: a linear rise over the warm-up, then a half cosine down to ``min_lr_scale``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    s, warm, total = step.cast("double"), as_column(warmup_steps), as_column(total_steps)
    rise = F.greatest(F.lit(1e-8), (s + 1) / F.greatest(F.lit(1), warm))
    t = F.least(F.lit(1.0), (s - warm) / F.greatest(F.lit(1), total - warm))
    fall = F.lit(min_lr_scale) + F.lit(0.5 * (1.0 - min_lr_scale)) * (1.0 + F.cos(F.lit(math.pi) * t))
    return F.when(s < warm, rise).otherwise(fall)


def moving_average(values: Column, decay: float = 0.999) -> Column:
    """The exponential moving average at the end of an ordered array, begun at its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, v: a * F.lit(decay) + v * F.lit(1.0 - decay))


def _changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Which rows of a batch, but for the first, begin another key."""
    out = np.zeros(batch.num_rows, bool)
    for column in batch.columns[:n_keys]:
        codes = np.asarray(column.dictionary_encode().indices.fill_null(-1))
        out[1:] |= codes[1:] != codes[:-1]
    return out


def ordered_average(df: DataFrame, by: list[str], order: list[str], value: str = "value", decay: float = 0.999, blocks: int | None = None) -> DataFrame:
    """``by`` with ``n`` and ``average``: the exponential moving average of each series' values at its end.

    A series is the rows of equal ``by`` (all rows, if there are none), in the order of ``order`` and then of the
    value; it begins at its first value. Null values take no part, a series of nulls has no row, and null keys
    are keys. What a run of rows does to the average is affine, so each range of a series becomes one factor and
    one sum, and those are composed in order. Rows are dealt by ranges of (by, order), once, so a series longer
    than a task is worked on by many; a task sends a row for each series that it has rows of.
    """
    if not 0.0 <= decay < 1.0:
        raise ValueError("decay must lie in [0, 1)")
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    sorting = [*keys, *(f"_order{i}" for i in range(len(order))), "_v"]
    n_blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n_blocks, *sorting).sortWithinPartitions(*sorting).select(*keys, F.spark_partition_id().alias("_block"), "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # of the last series: its row, count, factor, sum and first value

        def close(found: list[tuple]) -> pa.RecordBatch:
            heads = pa.Table.from_batches([f[0] for f in found]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*heads.columns[:-1], *(pa.array([f[i] for f in found], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))], names=[*heads.schema.names[:-1], "n", "a", "b", "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(len(keys) + 1))
            starts = np.flatnonzero(_changes(batch, len(keys)) | (np.arange(len(v)) == 0))
            size = np.diff(np.r_[starts, len(v)])
            left = np.repeat(starts + size, size) - 1 - np.arange(len(v))
            sums = np.add.reduceat((1.0 - decay) * decay**left * v, starts)
            ended = []
            for k, (at, n) in enumerate(zip(starts.tolist(), size.tolist())):
                head = batch.slice(at, 1)
                if k == 0 and open_ and all(a.equals(b) for a, b in zip(head.columns[: len(keys)], open_[0].columns)):
                    open_ = (open_[0], open_[1] + n, open_[2] * decay**n, open_[3] * decay**n + sums[k], open_[4])
                    continue
                if open_:
                    ended.append(open_)
                open_ = (head, n, decay**n, sums[k], v[at])
            if ended:
                yield close(ended)
        if open_:
            yield close([open_])

    kinds = dict(dealt.dtypes)
    runs = dealt.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_block int, n long, a double, b double, first double"]))
    composed = F.aggregate(F.array_sort(F.collect_list(F.struct("_block", "a", "b", "first"))), F.lit(None).cast("double"), lambda s, r: F.coalesce(s, r["first"]) * r["a"] + r["b"])
    out = runs.groupBy(*keys).agg(F.sum("n").alias("n"), composed.alias("average")).where("n > 0")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "average")
