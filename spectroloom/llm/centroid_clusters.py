"""Exact integer k-means whose lower bounds are loosened by the geometry of each cluster's sphere.

A vector keeps one bound: no centroid but its own is nearer than that. When centroids move, the bound has to
fall by as much as another centroid may have come nearer to any point of the cluster's sphere, which is less
than the whole drift unless the centroid moved straight towards the sphere. Vectors whose distance to their own
centroid stays below the bound keep their cluster; the others are compared with all centroids. Vectors never
leave their partition: a round sends one row of exact sums for each cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import checkpointed

DIMENSIONS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Values of centroids that may be sent to every task.
MAX_CENTROID_VALUES = 1 << 22
#: What bounds are loosened by, relatively, on account of rounding.
SLACK = 1e-9
#: Sums of squares below this are exact in doubles, and those below 2**63 in 64-bit integers.
EXACT = 1 << 53

#: Vectors have the first five columns; a task's row of a cluster has the cluster, its radius and its sums (count, inertia, components).
_STATE = "vec_id long, q binary, cluster int, near long, bound double, far long, sums array<long>"


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids; an error where they might not fit 64 bits."""
    most = int(max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)))
    if q.shape[1] * 4 * most * most < EXACT:
        a, b = q.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if q.shape[1] * 4 * most * most >= 1 << 63:
        raise ValueError(f"components up to {most} are too large for exact 64-bit distances")
    return np.stack([((q - k) ** 2).sum(1) for k in c], 1) if len(c) else np.zeros((len(q), 0), np.int64)


def to_own(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid each."""
    d = q - c
    most = int(np.abs(d).max(initial=0))
    if d.shape[1] * most * most >= 1 << 63:
        raise ValueError(f"differences up to {most} are too large for exact 64-bit distances")
    return (d * d).sum(1)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much, at most, each centroid (columns) has come nearer to a point of each cluster's sphere (rows).

    Points that are nearer by s to the new place than to the old one lie within a branch of a hyperbola around
    the new place, and so within its asymptotes' cone: its apex is the middle of the way, and the cosine of its
    half angle is s / way. In the plane through the way and the sphere's centre, the least half angle at which
    that cone meets the sphere is the centre's angle less the angle that the sphere fills, as seen from the apex.
    """
    way = after - before
    length = np.sqrt((way * way).sum(1))
    out = np.zeros((len(before), len(before)))
    for j in np.flatnonzero(length > 0):
        to = before - (before[j] + after[j]) / 2.0
        far = np.sqrt((to * to).sum(1))
        inside = radius >= far
        safe = np.where(far > 0, far, 1.0)
        angle = np.arccos(np.clip(to @ way[j] / (length[j] * safe), -1.0, 1.0)) - np.arcsin(np.clip(radius / safe, 0.0, 1.0))
        out[:, j] = length[j] * np.where(inside, 1.0, np.cos(np.clip(angle, 0.0, np.pi / 2)) + SLACK)
    return np.minimum(out, length)


def assign(q: np.ndarray, cluster: np.ndarray, bound: np.ndarray, c: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(cluster, squared distance, bound, which were compared with all centroids)``; a negative cluster is none yet.

    ``loose`` is what each cluster's bounds lose. Ties go to the smaller number, so a vector is only left where
    it is if its own centroid is nearer than the bound by more than rounding.
    """
    apart = np.sqrt(np.maximum(squared(c, c), 0).astype(float))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(1) / 2.0 * (1.0 - SLACK)
    known = cluster >= 0
    own = np.where(known, cluster, 0)
    near = to_own(q, c[own])
    bound = bound - loose[own]
    open_ = ~known | (np.sqrt(near.astype(float)) * (1.0 + SLACK) + SLACK >= np.maximum(bound, half[own]))
    cluster = own.astype(np.int32)
    if open_.any():
        d = squared(q[open_], c)
        best = d.argmin(1)
        near[open_] = d[np.arange(len(d)), best]
        cluster[open_] = best
        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
        bound[open_] = np.sqrt(d.min(1).astype(float)) * (1.0 - SLACK)
    return cluster, near, bound, open_


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    """Packed 32-bit rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(np.int32).reshape(len(column), dimensions).astype(np.int64)


def _round(state: DataFrame, c: np.ndarray, loose: np.ndarray, last: bool) -> DataFrame:
    """The vectors with their new clusters and, behind each task's vectors, a row of sums for each cluster."""
    shared = state.sparkSession.sparkContext.broadcast((c, loose))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, loose = shared.value
        k, d = c.shape
        n, inertia, far, sums = np.zeros(k, np.int64), [0] * k, np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        names = [f.split()[0] for f in _STATE.split(", ")]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            q = _rows(batch.column(1), d)
            cluster, near, bound, _ = assign(q, np.asarray(batch.column(2)), np.asarray(batch.column(3)), c, loose)
            for i in np.unique(cluster).tolist():
                own = cluster == i
                n[i] += own.sum()
                inertia[i] += sum(near[own].tolist())
                far[i] = max(far[i], near[own].max())
                sums[i] += q[own].sum(0)
            packed = pa.nulls(m, pa.binary()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(cluster), pa.array(near), pa.array(bound), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], names=names)
        held = np.flatnonzero(n)
        if m := len(held):
            found = [[int(n[i]), inertia[i], *sums[i].tolist()] for i in held]
            columns = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(held.astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(far[held]), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return state.select("vec_id", "q", "cluster", "bound").mapInArrow(run, _STATE)


def _totals(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, list[list[int]]]:
    """Radii (squared), and counts, inertias and component sums of the clusters; K x (D + 2) exact numbers whatever the rows."""
    far, sums = np.zeros(k), [[0] * (d + 2) for _ in range(k)]
    tasks = state.where("sums is not null").select("cluster", "far", F.posexplode("sums").alias("i", "v"))
    for r in tasks.groupBy("cluster", "i").agg(F.sum("v").alias("v"), F.max("far").alias("far")).collect():
        sums[r["cluster"]][r["i"]], far[r["cluster"]] = r["v"], r["far"]
    return far, sums


def centroid_clusters(vectors: DataFrame, vec_id: str = "vec_id", x: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector.

    Usable are vectors of exactly ``dimensions`` finite values; others, null ones too, have no row. A component
    counts as floor(scale * component). The first centroids are the vectors with the k smallest hashes of
    ``seed:vec_id`` (a null id hashes as an empty one; equal ids go by their values). Each round assigns, ties to the smaller
    number, and replaces the centroids of clusters that have vectors by the exact floor of their mean; the last
    assignment is returned. Repeated rows stay, each with its row; fewer than k vectors make as many clusters;
    an empty table gives no rows. Components too large for exact 64-bit distances are an error. Other columns
    are not read. Rounds are kept with ``persist``, so what a lost executor held is computed again.
    """
    if k <= 0 or rounds < 0 or dimensions <= 0 or k * dimensions > MAX_CENTROID_VALUES:
        raise ValueError(f"k and dimensions must be positive, with at most {MAX_CENTROID_VALUES} values")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(x).cast("array<double>").alias("x")).where(F.size("x") == dimensions).where(~bad)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return rows.sparkSession.createDataFrame([], schema)
    c = np.floor(np.array([r["x"] for r in starts]) * scale)
    if np.abs(c).max() >= 1 << 31:
        raise ValueError("components are too large for exact distances")
    c = c.astype(np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            q = np.floor(np.asarray(batch.column(1).flatten()) * scale)
            if np.abs(q).max(initial=0) >= 1 << 31:
                raise ValueError("components are too large for exact distances")
            data, offsets = q.astype(np.int32).tobytes(), np.arange(n + 1, dtype=np.int32) * (4 * dimensions)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, -np.inf))], names=["vec_id", "q", "cluster", "bound"])

    state = rows.mapInArrow(pack, "vec_id long, q binary, cluster int, bound double")
    loose, held = np.zeros(len(c)), None
    for step in range(rounds + 1):
        now = _round(state, c, loose, last=step == rounds).persist()
        far, sums = _totals(now, len(c), dimensions)
        if held is not None:
            held.unpersist()
        held, state = now, now.where("sums is null")
        if step < rounds:
            moved = np.array([[v // n for v in own] if n else c[i].tolist() for i, (n, _, *own) in enumerate(sums)], np.int64)
            by = loosening(c.astype(float), moved.astype(float), np.sqrt(far) * (1.0 + SLACK))
            np.fill_diagonal(by, 0.0)
            loose, c = by.max(1) * (1.0 + SLACK), moved
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    inertia = sum(own[1] for own in sums)
    found = rows.sparkSession.createDataFrame([(i, sums[i][1], inertia, digests[i]) for i in range(len(c))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("vec_id", "cluster", F.col("near").alias("distance")).join(F.broadcast(found), "cluster")  # k rows
    out = checkpointed(out.select(*[f.split()[0] for f in schema.split(", ")]))
    held.unpersist()
    return out
