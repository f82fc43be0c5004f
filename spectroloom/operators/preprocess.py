"""Row normalisation and farthest-point sampling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spectroloom.functions import rng
from spectroloom.functions import vectors as V
from spectroloom.operators.matrix import matrix, validate, vectors

#: Values (rows x dimensions) of a group that one task samples.
TILE_VALUES = 1 << 20
#: Rows of a larger group that a round picks from, and picks of a round in all groups together (one a group at least).
CANDIDATES, ROUND_PICKS = 1024, 4096
#: Rows that a sample without groups picks one a job, each compared with all before it; a larger one keeps distances.
STEPS = 64


class SNVScaler:
    """Standard normal variate of each row; stateless. ``transform_stats`` adds ``mu`` and ``sd`` (which holds eps)."""

    def __init__(self, eps: float = 1e-12, transform_stats: bool = False) -> None:
        self.eps, self.transform_stats = eps, transform_stats

    def transform(self, df: DataFrame, x: str = "x", output: str = "y") -> DataFrame:
        out = df.withColumn("_snv", V.snv_struct(V.vector(x), self.eps)).withColumn(output, F.col("_snv.y"))
        if self.transform_stats:
            out = out.withColumns({"mu": F.col("_snv.mu"), "sd": F.col("_snv.sd")})
        return out.drop("_snv")

    def inverse_transform(self, df: DataFrame, y: str = "y", mu: str = "mu", sd: str = "sd", output: str = "x") -> DataFrame:
        return df.withColumn(output, V.inverse_snv(V.vector(y), F.col(mu), F.col(sd)))


def sample_size(n: int, ratio: float) -> int:
    """Rows that a ratio selects: at least one, half rounded to even."""
    return min(max(1, round(n * ratio)), n)


def cosine_fps_downsample(df: DataFrame, row_id: str = "row_id", x: str = "x", ratio: float = 0.1, k: int | None = None, seed: int | None = None, init: int | None = None, eps: float = 1e-12) -> DataFrame:
    """Farthest-point sampling by cosine: ``(rank, row_id, x)`` in the order of selection, rows as they were.

    The first row is ``init`` or a seeded draw; each next one is farthest from all before it (ties: smallest
    id). Up to ``STEPS`` rows take one job a step: each batch compares its rows with the selected ones and
    sends its farthest. Larger samples keep each row's distance and pick many rows a round, the same ones.
    """
    rows = vectors(df, row_id, x)
    n = rows.count()
    if n == 0:
        return rows.select(F.lit(0).alias("rank"), "row_id", "x")
    validate(rows)
    size = k if k is not None else sample_size(n, ratio)
    if init is None:
        if seed is None:
            raise ValueError("give a seed or the first row's id")
        start = rows.agg(F.min_by("row_id", F.struct(rng.digest(seed, F.col("row_id"), "fps"), "row_id"))).first()[0]
    else:
        start = init
    first = rows.where(F.col("row_id") == start).select("x").first()
    if first is None:
        raise ValueError(f"no row {start}")
    if min(size, n) > STEPS:
        return _fps_rounds(rows.withColumn("group", F.lit("all")), {"all": min(size, n)}, eps, start).select("rank", "row_id", "x")
    held = rows.persist()
    ids, chosen = [start], [_normal(np.array([first[0]]), eps)[0]]
    while len(ids) < min(size, n):
        selected, taken = np.array(chosen), np.array(ids)

        def farthest(batches: Iterator[pa.RecordBatch], selected=selected, taken=taken) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column(1))
                if not len(m):
                    continue
                u = _normal(m, eps)
                d = np.min([_far(u, v) for v in selected], axis=0)
                rid = np.asarray(batch.column(0))
                d[np.isin(rid, taken)] = -np.inf
                best = np.lexsort((rid, -d))[:1]
                yield pa.RecordBatch.from_arrays([pa.array(d[best]), batch.column(0).take(pa.array(best)), batch.column(1).take(pa.array(best))], names=["d", "row_id", "x"])

        far = held.mapInArrow(farthest, "d double, row_id long, x array<double>").agg(F.max(F.struct("d", -F.col("row_id"), "x")).alias("m")).first()["m"]
        ids.append(-far[1])
        chosen.append(_normal(np.array([far[2]]), eps)[0])
    held.unpersist()
    order = df.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(ids)], "rank int, row_id long")
    return rows.join(F.broadcast(order), "row_id").select("rank", "row_id", "x")


def grouped_fps(df: DataFrame, group: str, row_id: str = "row_id", x: str = "x", ratio: float = 0.1, eps: float = 1e-12) -> DataFrame:
    """Farthest-point sampling within each group, from its smallest id on: ``(group, rank, row_id, x)``.

    Groups of up to ``TILE_VALUES`` values, by their counts, are sampled in a task each; larger ones all
    together in rounds over their rows, with the same picks.
    """
    rows = df.select(F.col(group).cast("string").alias("group"), F.col(row_id).cast("long").alias("row_id"), F.col(x).cast("array<double>").alias("x"))

    def sample(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row_id")
        u = _normal(matrix(table.column("x").combine_chunks()), eps)
        picked, d = [0], np.full(len(u), np.inf)
        for _ in range(sample_size(len(u), ratio) - 1):
            d = np.minimum(d, _far(u, u[picked[-1]]))
            d[picked] = -np.inf
            picked.append(int(d.argmax()))
        out = table.take(pa.array(picked))
        return pa.table([out["group"], pa.array(np.arange(len(picked), dtype=np.int32)), out["row_id"], out["x"]], names=["group", "rank", "row_id", "x"])

    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"))
    large = {r["group"]: r["n"] for r in sizes.where(F.col("n") * F.col("width") > TILE_VALUES).collect()}  # few: each has so many values
    if not large:
        return rows.groupBy("group").applyInArrow(sample, "group string, rank int, row_id long, x array<double>")
    names = F.broadcast(df.sparkSession.createDataFrame([(g,) for g in large], "name string"))
    same = F.col("group").eqNullSafe(F.col("name"))
    small = rows.join(names, same, "left_anti").groupBy("group").applyInArrow(sample, "group string, rank int, row_id long, x array<double>")
    return small.unionByName(_fps_rounds(rows.join(names, same, "left_semi"), {g: sample_size(n, ratio) for g, n in large.items()}, eps))


def _normal(m: np.ndarray, eps: float) -> np.ndarray:
    return m / (np.sqrt((m * m).sum(1, keepdims=True)) + eps)


def _far(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine distances to one row, each the same wherever its row stands."""
    return 1.0 - np.clip((u * v).sum(1), -1.0, 1.0)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set as configured; made for a local session that has none."""
    sc, configured = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not configured and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def _fps_rounds(rows: DataFrame, size: dict[str | None, int], eps: float, start: int | None = None) -> DataFrame:
    """Samples of ``size`` rows of each group, many picks a round, from ``start`` or the smallest id on.

    Each round takes the rows of a group that are farthest from its picks so far. Distances only get less,
    so a row of these is the next pick as long as it comes before the last of them as they were. Rows with
    their distances are written each round in the shared checkpoint folder, and the round before is deleted.
    """
    spark, schema = rows.sparkSession, "group string, row_id long, uid long, x array<double>, d double"
    folder = f"{_shared_folder(spark)}/fps-{uuid.uuid4().hex}"
    each = max(1, ROUND_PICKS // len(size))
    far = F.lit(float("inf"))
    far = far if start is None else F.when(F.col("row_id") == start, far).otherwise(F.lit(1e300))  # others come after it
    rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("d", far).select("group", "row_id", "uid", "x", "d").write.parquet(f"{folder}/0")
    done, turn = dict.fromkeys(size, 0), 0

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            keys = np.array([batch.column(k).to_numpy() for k in (1, 2)]).T
            d = batch.column(3).to_numpy()
            for g in set(names.tolist()):
                at = np.array([name == g for name in names])
                ids, far = keys[at], d[at]
                if g in held:
                    ids, far = np.concatenate([held[g][0], ids]), np.concatenate([held[g][1], far])
                best = np.lexsort((ids[:, 1], ids[:, 0], -far))[:CANDIDATES]
                held[g] = ids[best], far[best]
        for g, (ids, far) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(far), pa.string()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(far)], names=["group", "row_id", "uid", "d"])

    while any(done[g] < size[g] for g in size):
        state = spark.read.schema(schema).parquet(f"{folder}/{turn}")
        open_groups = [g for g in size if done[g] < size[g]]
        wanted = F.broadcast(spark.createDataFrame([(g, done[g], size[g]) for g in open_groups], "name string, done int, size int"))
        key = F.struct((-F.col("d")).alias("d"), "row_id", "uid")
        order = W.partitionBy("group").orderBy("key")
        firsts = state.where("d >= 0").select("group", "row_id", "uid", "d").mapInArrow(top, "group string, row_id long, uid long, d double")
        last = firsts.select("group", key.alias("key")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= CANDIDATES).groupBy("group").agg(F.max("key").alias("last"))
        last = F.broadcast(last.join(wanted, F.col("group").eqNullSafe(F.col("name"))).select("name", "last", "done", "size"))
        near = state.where("d >= 0").join(last, F.col("group").eqNullSafe(F.col("name"))).where(key <= F.col("last")).drop("name")

        def pick(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            u, d = _normal(matrix(table.column("x").combine_chunks()), eps), table.column("d").to_numpy().copy()
            row, uid = table.column("row_id").to_numpy(), table.column("uid").to_numpy()
            end = table.column("last")[0].as_py()
            limit = (end["d"], end["row_id"], end["uid"])
            rank, stop, picked = table.column("done")[0].as_py(), table.column("size")[0].as_py(), []
            while len(picked) < min(each, stop - rank):
                best = int(np.lexsort((uid, row, -d))[0])
                if d[best] == -np.inf or (-d[best], row[best], uid[best]) > limit:
                    break
                picked.append(best)
                d = np.minimum(d, _far(u, u[best]))
                d[picked] = -np.inf
            out = table.take(pa.array(picked, pa.int64()))
            return pa.table([out["group"], pa.array(np.arange(rank, rank + len(picked), dtype=np.int32)), out["row_id"], out["uid"], out["x"]], names=["group", "rank", "row_id", "uid", "x"])

        near.groupBy("group").applyInArrow(pick, "group string, rank int, row_id long, uid long, x array<double>").write.parquet(f"{folder}/picks/turn={turn}")
        found: dict = {}
        for r in spark.read.parquet(f"{folder}/picks/turn={turn}").collect():  # about ROUND_PICKS
            found.setdefault(r["group"], []).append((r["uid"], r["x"]))
        new = {g: (np.array([u for u, _ in v]), _normal(np.array([x for _, x in v]), eps)) for g, v in found.items()}
        for g, v in found.items():
            done[g] += len(v)
        shared = spark.sparkContext.broadcast(new)

        def nearer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.column(0).to_pylist()
                u, d, uid = _normal(matrix(batch.column(3)), eps), batch.column(4).to_numpy().copy(), batch.column(2).to_numpy()
                for g in set(names) & set(shared.value):
                    at = np.flatnonzero([name == g for name in names])
                    for v in shared.value[g][1]:
                        d[at] = np.minimum(d[at], _far(u[at], v))
                    d[at[np.isin(uid[at], shared.value[g][0])]] = -np.inf
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d)], names=["group", "row_id", "uid", "x", "d"])

        state.mapInArrow(nearer, schema).write.parquet(f"{folder}/{turn + 1}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{turn}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        turn += 1
    return spark.read.parquet(f"{folder}/picks").select("group", "rank", "row_id", "x")
