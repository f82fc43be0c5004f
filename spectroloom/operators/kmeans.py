"""Spherical k-means with distributed EM passes; all models of a sweep advance in one job."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.functions import rng
from spectroloom.operators import exact
from spectroloom.operators.matrix import fits, lists, matrix, spread, unit, usable_matrix, validate, vectors
from spectroloom.operators.nearest import best, in_blocks
from spectroloom.operators.selection import find_elbow_curvature
from spectroloom.sources import versions

#: A cluster's sums: limbs of its rows, those of its gaps (which are up to 2), and how many rows it has.
STATS = "model int, k int, s array<double>"
GAP_WHOLE = 2
#: Passes after which a fit that can be resumed writes its state.
EVERY = 5


def summed(parts: DataFrame, most_from: int | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Each task's sums added up by (model, k), value by value: integers below 2**53, so exactly and in any order.

    Of the values from place ``most_from`` on, if given, the largest is taken instead.
    """
    each = F.sum("v") if most_from is None else F.when(F.col("i") < most_from, F.sum("v")).otherwise(F.max("v"))
    values = parts.select("model", "k", F.posexplode("s").alias("i", "v")).groupBy("model", "k", "i").agg(each.alias("v"))
    found = {c: np.asarray(values_) for c, values_ in zip(("model", "k", "i", "v"), values.toArrow().columns)}
    order = np.lexsort((found["i"], found["k"], found["model"]))
    model, k, v = (found[c][order] for c in ("model", "k", "v"))
    first = np.flatnonzero(np.r_[True, (model[1:] != model[:-1]) | (k[1:] != k[:-1])]) if len(v) else np.zeros(0, int)
    return {(int(model[i]), int(k[i])): part for i, part in zip(first, np.split(v, first[1:]))} if len(v) else {}


def stat_rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """A task's sums as rows of STATS."""
    return pa.RecordBatch.from_arrays([pa.array([m for m, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()), lists(np.array(list(sums.values())))], names=["model", "k", "s"])


def _cluster_limbs(u: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Limbs of each row and of its gap, side by side, and a one: (rows, LIMBS * (D + 1) + 1)."""
    both = np.concatenate([exact.limbs(u), exact.limbs(gap[:, None], whole=GAP_WHOLE)], 2)
    return np.c_[both.transpose(1, 0, 2).reshape(len(u), -1), np.ones(len(u))]


#: Clusters up to which a batch's sums are one product with the rows' memberships.
FEW = 256


def _of_clusters(of_rows: np.ndarray, gap: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """A batch's sums of k clusters, laid out as _cluster_limbs: integers below 2**53, so exact either way."""
    both = np.concatenate([of_rows, exact.limbs(gap[:, None], whole=GAP_WHOLE)], 2).transpose(1, 0, 2).reshape(len(gap), -1)
    both = np.c_[both, np.ones(len(gap))]
    if k <= FEW:
        member = np.zeros((k, len(gap)))
        member[label, np.arange(len(gap))] = 1.0
        return member @ both
    order = np.argsort(label, kind="stable")
    return np.add.reduceat(both[order], np.searchsorted(label[order], np.arange(k)), axis=0)


def lloyd_pass(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One E step and the sums of the M step for each model: cluster sums, counts, and the mean of 1 - cosine.

    What a task sends is one row for each cluster of each model, whatever its rows; the driver gets as many.
    Sums are exact, and so the same bits on any partitioning. Models that do not fit a task together go one by
    one, and one that does not fit alone is met in blocks.
    """
    d = next(iter(models.values())).shape[1]
    if not fits(sum(len(c) for c in models.values()), d):
        if len(models) > 1:
            return {m: lloyd_pass(rows, {m: c})[m] for m, c in models.items()}
        return {m: _blocked_pass(rows, c) for m, c in models.items()}
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        every, bound = np.concatenate(list(shared.value.values())), np.cumsum([0, *map(len, shared.value.values())])
        for batch in batches:
            u = unit(matrix(batch.column(1)))
            if not len(u):
                continue
            of_rows, similarity = exact.limbs(u), exact.dots(u, every)
            for m, lo, hi in zip(shared.value, bound, bound[1:]):
                near, label = best(similarity[:, lo:hi])
                held = np.unique(label)
                found = _of_clusters(of_rows, 1.0 - near, np.searchsorted(held, label), len(held))
                for k, v in zip(held.tolist(), found):
                    sums[m, k] = sums.get((m, k), 0.0) + v
        if sums:
            yield stat_rows(sums)

    found = summed(rows.select("row_id", "x").mapInArrow(stats, STATS))
    return {m: _totals({k: v for (own, k), v in found.items() if own == m}, len(c), d) for m, c in models.items()}


def _totals(found: dict[int, np.ndarray], k: int, d: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums, counts and mean gap of k clusters from their limbs."""
    s, n, gaps = np.zeros((k, d)), np.zeros(k), np.zeros((exact.LIMBS, 1), object)
    for i, v in found.items():
        if v[-1] > exact.MOST_ROWS:
            raise OverflowError(f"a cluster has {v[-1]:.0f} rows, exact sums hold {exact.MOST_ROWS}")
        held = v[:-1].reshape(exact.LIMBS, d + 1)
        s[i], n[i] = exact.value(held[:, :d]), v[-1]
        gaps += held[:, d:].astype(np.int64).astype(object)
    return s, n, float(exact.value(gaps, GAP_WHOLE)[0] / n.sum())


def _labelled(rows: DataFrame, centroids: np.ndarray, with_x: bool) -> DataFrame:
    """``(row_id, similarity, label)``, and ``x`` if asked for, by blocks of rows and of centroids."""
    k, d = centroids.shape
    table = pa.table({"k": np.arange(k, dtype=np.int32), "centre": lists(centroids)})
    centres = rows.sparkSession.createDataFrame(table)

    def partial(x: np.ndarray, a: pa.Table, c: np.ndarray, b: pa.Table) -> dict[str, pa.Array]:
        order = np.argsort(np.asarray(b.column("k")))  # equal similarities go to the lowest number
        similarity, at = best(exact.dots(unit(x), c[order]))
        return {"similarity": pa.array(similarity), "label": pa.array(np.asarray(b.column("k"))[order][at].astype(np.int32) if len(order) else at.astype(np.int32))}

    first = F.max(F.struct("similarity", (-F.col("label")).alias("back"))).alias("first")
    found = in_blocks(rows, centres, d, k, ["row_id"], partial, "similarity double, label int", [first], with_x)
    return found.select("row_id", *["x"] * with_x, F.col("first.similarity").alias("similarity"), (-F.col("first.back")).alias("label"))


def _blocked_pass(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    d = centroids.shape[1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = _cluster_limbs(unit(matrix(batch.column(0), d)), 1.0 - np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(2), lists(found)], names=["model", "k", "s"])

    found = summed(_labelled(rows, centroids, True).select("x", "similarity", "label").mapInArrow(split, STATS))
    return _totals({k: v for (_, k), v in found.items()}, *centroids.shape)


def seed_centroids(rows: DataFrame, k: int, seed: int, least: float = 1e-12) -> np.ndarray:
    """k-means++ by cosine: each next row is drawn with weight 1 - best cosine, in one job.

    A draw is an exponential race: the row with the smallest -ln(u) / weight wins, u from (seed, row,
    draw). So the first centroids of a larger k are those of a smaller one.
    """
    chosen = np.zeros((0, 0))
    for step in range(k):
        u = rng.uniform(rng.digest(seed, F.col("row_id"), f"seed{step}"))
        raced = rows.select("row_id", "x", (-F.log(F.lit(1.0) - u)).alias("race"))
        now = chosen

        def race(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit(matrix(batch.column(1)))
                if not len(x):
                    continue
                weight = np.maximum(1.0 - (x @ now.T).max(1), least) if len(now) else np.ones(len(x))
                time = np.asarray(batch.column(2)) / weight
                best = np.lexsort((np.asarray(batch.column(0)), time))[:1]
                yield pa.RecordBatch.from_arrays([pa.array(time[best]), batch.column(0).take(pa.array(best)), lists(x[best])], names=["time", "row_id", "x"])

        won = raced.mapInArrow(race, "time double, row_id long, x array<double>").agg(F.min(F.struct("time", "row_id", "x")).alias("m")).first()["m"]
        row = np.array(won["x"])[None, :]
        chosen = np.concatenate([chosen, row]) if len(chosen) else row
    return chosen


def _farthest(rows: DataFrame, centroids: np.ndarray, m: int) -> np.ndarray:
    """The m rows least like their centroid, farthest first."""
    if not fits(*centroids.shape):
        far = _labelled(rows, centroids, True).select((1.0 - F.col("similarity")).alias("gap"), "row_id", "x")
        return unit(np.array([r["x"] for r in far.orderBy(F.desc("gap"), "row_id").limit(m).collect()]))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            if len(x):
                gap = 1.0 - best(exact.dots(x, shared.value))[0]
                first = np.lexsort((np.asarray(batch.column(0)), -gap))[:m]
                yield pa.RecordBatch.from_arrays([pa.array(gap[first]), batch.column(0).take(pa.array(first)), lists(x[first])], names=["gap", "row_id", "x"])

    far = rows.select("row_id", "x").mapInArrow(gaps, "gap double, row_id long, x array<double>").orderBy(F.desc("gap"), "row_id").limit(m).collect()
    return np.array([r["x"] for r in far])


class Progress:
    """The state of a fit in a versioned folder: what each model has come to, and what it was asked for.

    ``asked`` has to be the same when a fit is resumed. Arrays are stored as rows (model, part, k, values), so
    they come back bit by bit.
    """

    def __init__(self, spark: SparkSession, path: str, asked: dict, every: int = EVERY) -> None:
        self.spark, self.path, self.asked, self.every = spark, path, json.loads(json.dumps(asked)), every

    def load(self) -> tuple[int, dict[int, list[np.ndarray]], dict[int, dict]] | None:
        """``(step, arrays, notes)`` of each model, or none if nothing was written."""
        found = versions.latest(self.spark, self.path)
        if found is None:
            return None
        if found.meta.get("asked") != self.asked:
            raise ValueError(f"{self.path} holds a fit of {found.meta.get('asked')}, not of {self.asked}")
        arrays: dict[int, list[np.ndarray]] = {int(m): [] for m in found.meta["notes"]}
        rows = sorted(found.rows.toArrow().to_pylist(), key=lambda r: (r["model"], r["part"], r["k"]))
        for m in arrays:
            for part in sorted({r["part"] for r in rows if r["model"] == m}):
                arrays[m].append(np.array([r["v"] for r in rows if r["model"] == m and r["part"] == part]))
        return found.meta["step"], arrays, {int(m): v for m, v in found.meta["notes"].items()}

    def save(self, step: int, arrays: dict[int, list[np.ndarray]], notes: dict[int, dict]) -> None:
        held = [(m, part, k, np.atleast_1d(v)) for m, parts in arrays.items() for part, a in enumerate(parts) for k, v in enumerate(a)]
        columns = [pa.array([h[i] for h in held], pa.int32()) for i in range(3)]
        table = pa.table({"model": columns[0], "part": columns[1], "k": columns[2], "v": pa.array([h[3] for h in held], pa.list_(pa.float64()))})
        versions.publish(self.spark.createDataFrame(table).coalesce(1), self.path, {"asked": self.asked, "step": step, "notes": {str(m): v for m, v in notes.items()}})


def fit_models(rows: DataFrame, starts: dict[int, np.ndarray], tol: float, max_iter: int, progress: Progress | None = None) -> dict[int, tuple[np.ndarray, float, int]]:
    """Centroids, inertia (of the E step before the last M step) and iterations of each model, in lock step.

    With ``progress``, the state is written every few passes and at the end, and taken up again from there.
    """
    models, notes, first = {m: unit(c) for m, c in starts.items()}, {m: {} for m in starts}, 1
    if progress and (held := progress.load()):
        step, arrays, notes = held
        models, first = {m: a[0] for m, a in arrays.items()}, step + 1
    for step in range(first, max_iter + 1):
        live = {m: c for m, c in models.items() if "done" not in notes[m]}
        if not live:
            break
        for m, (s, n, inertia) in lloyd_pass(rows, live).items():
            c = unit(s / np.maximum(n, 1.0)[:, None])
            empty = np.flatnonzero(n == 0)
            if len(empty):
                far = _farthest(rows, live[m], len(empty))
                c[empty[: len(far)]] = far
            before, gap = notes[m].get("inertia"), np.inf
            if before is not None:
                gap = abs(before - inertia)
            if gap < tol * 1e-3 or gap / (abs(before if before is not None else 1.0) + 1e-12) < tol or step == max_iter:
                notes[m]["done"], c = step, unit(c)
            models[m], notes[m]["inertia"] = c, inertia
        if progress and (step % progress.every == 0 or all("done" in v for v in notes.values())):
            progress.save(step, {m: [c] for m, c in models.items()}, notes)
    return {m: (models[m], notes[m]["inertia"], notes[m]["done"]) for m in models}


class CosineKMeans:
    """Spherical k-means. Seeds, passes and repairs do not depend on the partitioning."""

    def __init__(self, n_components: int = 8, tol: float = 1e-4, max_iter: int = 500, random_state: int = 42) -> None:
        if n_components <= 0 or max_iter <= 0:
            raise ValueError("n_components and max_iter must be positive")
        self.n_components, self.tol, self.max_iter, self.random_state = n_components, tol, max_iter, random_state
        self.centroids: np.ndarray | None = None
        self.inertia_: float | None = None
        self.n_iter_ = 0

    def fit(self, df: DataFrame, row_id: str = "row_id", x: str = "x", init: np.ndarray | None = None, resume: str | None = None, every: int = EVERY) -> CosineKMeans:
        """Seed (or start at ``init``) and iterate; with ``resume``, keep the state below that path and go on from what is there."""
        rows = vectors(df, row_id, x).persist()
        if validate(rows, least=self.n_components) is None:
            raise ValueError("fewer rows than clusters")
        progress = Progress(df.sparkSession, resume, {"fit": "kmeans", **self._parameters()}, every) if resume else None
        if progress and (held := progress.load()):
            start = held[1][0][0]
        else:
            start = init if init is not None else seed_centroids(rows, self.n_components, self.random_state)
            if progress:
                progress.save(0, {0: [unit(start)]}, {0: {}})
        self.centroids, self.inertia_, self.n_iter_ = fit_models(rows, {0: start}, self.tol, self.max_iter, progress)[0]
        rows.unpersist()
        return self

    def _parameters(self) -> dict:
        return {"n_components": self.n_components, "tol": self.tol, "max_iter": self.max_iter, "random_state": self.random_state}

    def predict(self, df: DataFrame, row_id: str = "row_id", x: str = "x", return_dist: bool = False) -> DataFrame:
        """``(row_id, label)`` and with ``return_dist`` the distances to all centroids; ties go to the lowest label.

        A row that is null or holds a null or non-finite value has a null label (and distances); one of another
        length than the centroids is an error. Centroids beyond what a task may hold are met in blocks.
        """
        if self.centroids is None:
            raise RuntimeError("fit first")
        if not fits(*self.centroids.shape):
            return self._predict_in_blocks(vectors(df, row_id, x), return_dist)
        centroids = df.sparkSession.sparkContext.broadcast(self.centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centroids.value
            for batch in batches:
                good, m = usable_matrix(batch.column(1), c.shape[1])
                similarity = exact.dots(unit(m), c)
                columns = [batch.column(0), spread(good, pa.array(best(similarity)[1].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*columns, spread(good, lists(1.0 - similarity))] if return_dist else columns, names=["row_id", "label", "dist"][: 2 + return_dist])

        return vectors(df, row_id, x).mapInArrow(assign, "row_id long, label int" + ", dist array<double>" * return_dist)

    def _predict_in_blocks(self, rows: DataFrame, return_dist: bool) -> DataFrame:
        c = self.centroids
        good = F.coalesce(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
        null = rows.where(~good).select("row_id", F.lit(None).cast("int").alias("label"))
        if not return_dist:
            return _labelled(rows.where(good), c, False).select("row_id", "label").unionAll(null)
        centres = rows.sparkSession.createDataFrame(pa.table({"k": np.arange(len(c), dtype=np.int32), "centre": lists(c)}))

        def partial(x: np.ndarray, a: pa.Table, c: np.ndarray, b: pa.Table) -> dict[str, pa.Array]:
            k = np.asarray(b.column("k")).astype(np.int32)
            d = 1.0 - exact.dots(unit(x), c)
            return {"ks": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(k), pa.array(np.tile(k, len(x)))), "ds": lists(d)}

        pairs = F.flatten(F.collect_list(F.arrays_zip("ks", "ds"))).alias("pairs")
        found = in_blocks(rows.where(good), centres, c.shape[1], len(c), ["row_id"], partial, "ks array<int>, ds array<double>", [pairs])
        found = found.select("row_id", F.array_sort("pairs").alias("pairs")).select("row_id", F.col("pairs.ds").alias("dist"))
        found = found.select("row_id", (F.array_position("dist", F.array_min("dist")) - 1).cast("int").alias("label"), "dist")
        return found.unionAll(null.withColumn("dist", F.lit(None).cast("array<double>")))

    def fit_predict(self, df: DataFrame, row_id: str = "row_id", x: str = "x") -> DataFrame:
        return self.fit(df, row_id, x).predict(df, row_id, x)

    def final_inertia(self, df: DataFrame, row_id: str = "row_id", x: str = "x") -> float:
        """Mean distance to the stored centroids, which is one M step after ``inertia_``."""
        return lloyd_pass(vectors(df, row_id, x), {0: self.centroids})[0][2]

    def save_centroids(self, spark: SparkSession, path: str) -> None:
        """Publish the centroids as a new version below ``path``; readers see the one before until it is whole."""
        if self.centroids is None:
            raise RuntimeError("fit first")
        rows = spark.createDataFrame(pa.table({"k": np.arange(len(self.centroids), dtype=np.int32), "centroid": lists(self.centroids)}))
        versions.publish(rows.coalesce(1), path, {"model": "kmeans", "inertia": self.inertia_, "n_iter": self.n_iter_, **self._parameters()})

    def load_centroids(self, spark: SparkSession, path: str, strict_k: bool = True) -> CosineKMeans:
        """Take the centroids of the newest whole version below ``path``."""
        found = versions.latest(spark, path)
        if found is None or found.meta.get("model") != "kmeans" or not {"k", "centroid"} <= set(found.rows.columns):
            raise KeyError("not saved centroids")
        rows = found.rows.orderBy("k").toArrow()
        if strict_k and rows.num_rows != self.n_components:
            raise ValueError(f"{rows.num_rows} centroids saved, {self.n_components} asked for")
        self.n_components = rows.num_rows
        self.centroids = unit(matrix(rows.column("centroid").combine_chunks()))
        self.inertia_, self.n_iter_ = found.meta["inertia"], found.meta["n_iter"]
        return self


def elbow_ckmeans(df: DataFrame, k_max: int = 50, row_id: str = "row_id", x: str = "x", random_state: int = 42, tol: float = 1e-4, max_iter: int = 500, init: np.ndarray | None = None, resume: str | None = None) -> tuple[list[int], list[float], int, int, float]:
    """K = 1..k_max with one seed: K values, inertias, and the elbow's K, index and curvature.

    All models share each pass over the data; those that have converged drop out. ``init`` gives the
    first k_max centroids instead of the seed; ``resume`` is a path for the sweep's state, as in ``fit``.
    """
    rows = vectors(df, row_id, x).persist()
    validate(rows)
    seeds = init if init is not None else seed_centroids(rows, k_max, random_state)
    progress = Progress(df.sparkSession, resume, {"fit": "kmeans sweep", "k_max": k_max, "tol": tol, "max_iter": max_iter, "random_state": random_state}) if resume else None
    fitted = fit_models(rows, {k: seeds[:k] for k in range(1, k_max + 1)}, tol, max_iter, progress)
    rows.unpersist()
    ks = list(range(1, k_max + 1))
    inertias = [fitted[k][1] for k in ks]
    return ks, inertias, *find_elbow_curvature(ks, inertias)
