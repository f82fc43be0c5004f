"""Exact cosine silhouettes in O(rows x clusters), from each cluster's sum of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.functions import vectors as V
from spectroloom.operators.matrix import fits, matrix, unit
from spectroloom.operators.nearest import best, in_blocks


def silhouette_samples_cosine(df: DataFrame, row_id: str = "row_id", x: str = "x", label: str = "label", eps: float = 1e-12, most: int | None = None) -> DataFrame:
    """``(row_id, label, silhouette)`` of every row; labels may be any integers.

    A row alone in its cluster has 0, a zero row is at distance 1 from everything, and with a single
    cluster every other row is NaN. A row whose label is null, or whose vector is null or holds a null or
    non-finite value, belongs to no cluster and has a null silhouette; other rows must be of one length.
    Cluster sums are added up on the executors. If they fit a task, which may hold ``most`` values
    (MAX_BROADCAST_VALUES unless given), every task gets them; any greater number is met in blocks and never
    reaches the driver.
    """
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(x).cast("array<double>").alias("x"), F.col(label).cast("long").alias("label"))
    good = F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    left_out = rows.where("not good").select("row_id", "label", F.lit(None).cast("double").alias("silhouette"))
    rows = rows.where("good").select("row_id", "x", "label")
    sums = rows.groupBy("label").agg(Summarizer.sum(array_to_vector(V.l2_normalize(F.col("x"), eps))).alias("s"), F.count("*").alias("n"))
    sums = sums.select("label", vector_to_array("s").alias("s"), "n").persist()
    size = sums.agg(F.count("*").alias("k"), F.max(F.size("s")).alias("d")).first()
    if not size["k"]:
        sums.unpersist()
        return left_out
    if not fits(size["k"], size["d"], most):
        return _in_blocks(rows, sums, size["d"], size["k"], eps, most).unionAll(left_out)
    found = sorted(sums.collect(), key=lambda r: r["label"])
    sums.unpersist()
    s = np.array([r["s"] for r in found])
    shared = df.sparkSession.sparkContext.broadcast((np.array([r["label"] for r in found]), s, np.array([float(r["n"]) for r in found])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, s, n = shared.value
        for batch in batches:
            u, y = unit(matrix(batch.column(1)), eps), np.asarray(batch.column(2))
            k, at = np.searchsorted(labels, y), np.arange(len(y))
            alone = n[k] == 1
            a = 1.0 - ((u * s[k]).sum(1) - (u * u).sum(1)) / np.where(alone, 1.0, n[k] - 1.0) if len(y) else np.zeros(0)
            other = u @ (s / n[:, None]).T if len(y) else np.zeros((0, len(n)))
            other[at, k] = -np.inf
            b = 1.0 - other.max(1) if len(y) else np.zeros(0)
            with np.errstate(invalid="ignore"):
                value = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(value)], names=["row_id", "label", "silhouette"])

    return rows.mapInArrow(score, "row_id long, label long, silhouette double").unionAll(left_out)


def _in_blocks(rows: DataFrame, sums: DataFrame, dimensions: int, n_labels: int, eps: float, most: int | None) -> DataFrame:
    """Silhouettes against any number of cluster sums: each block gives the nearest other mean, and the own sum where it has it."""

    def partial(x: np.ndarray, a: pa.Table, s: np.ndarray, b: pa.Table) -> dict[str, pa.Array]:
        u, y, labels, n = unit(x, eps), np.asarray(a.column("label")), np.asarray(b.column("cluster")), np.asarray(b.column("n")).astype(float)
        order = np.argsort(labels)
        at = order[np.minimum(np.searchsorted(labels[order], y), max(len(labels) - 1, 0))] if len(labels) else np.zeros(len(y), np.int64)
        held = np.flatnonzero(labels[at] == y) if len(y) else np.zeros(0, np.int64)
        other = u @ (s / n[:, None]).T
        other[held, at[held]] = -np.inf
        own, count = np.full(len(y), np.nan), np.zeros(len(y))
        own[held] = (u[held] * s[at[held]]).sum(1) - (u[held] * u[held]).sum(1)
        count[held] = n[at[held]]
        return {"other": pa.array(best(other)[0]), "own": pa.array(own, mask=np.isnan(own)), "n": pa.array(count)}

    merge = [F.max("other").alias("other"), F.max("own").alias("own"), F.max("n").alias("n")]
    found = in_blocks(rows, sums.select(F.col("label").alias("cluster"), F.col("s").alias("centre"), "n"), dimensions, n_labels, ["row_id", "label"], partial, "other double, own double, n double", merge, most=most)
    a, b = F.lit(1.0) - F.col("own") / (F.col("n") - 1.0), F.lit(1.0) - F.col("other")
    nan = F.lit(float("nan"))
    value = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("other") == float("-inf"), nan).otherwise((b - a) / F.greatest(a, b, F.lit(1e-12)))
    return found.select("row_id", "label", value.alias("silhouette"))


def silhouette_score_cosine(df: DataFrame, row_id: str = "row_id", x: str = "x", label: str = "label", eps: float = 1e-12) -> float:
    """The mean silhouette."""
    return silhouette_samples_cosine(df, row_id, x, label, eps).agg(F.avg("silhouette")).first()[0]
