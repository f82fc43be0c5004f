import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectroloom.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<double>, cluster int, q string, sums int"


def brute(rows, k=8, rounds=10, d=64):
    """All distances in every round, with Python's integers."""
    q = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in rows if x is not None and len(x) == d and all(v is not None and np.isfinite(v) for v in x)]
    c = [x for _, x in sorted(q, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for step in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c)) for _, x in q]
        if step < rounds:
            for j in range(len(c)):
                own = [x for (_, x), (_, b) in zip(q, best) if b == j]
                if own:
                    c[j] = [sum(v) // len(own) for v in zip(*own)]
    total = sum(b[0] for b in best)
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d2, sum(b[0] for b in best if b[1] == j), total, sha[j]) for (i, _), (d2, j) in zip(q, best)), key=str)


def found(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def data(spark, rows, parts=5):
    return spark.createDataFrame([(i, x, 7, "q", 1) for i, x in rows], SCHEMA).repartition(parts)


def test_clusters_match_brute_force(spark):
    g = np.random.default_rng(1)
    rows = [(i, (g.normal(size=64) * 0.2 + 0.5 * (i % 5 == np.arange(64) % 5)).tolist()) for i in range(300)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (7, rows[9][1]), (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] * 64), (906, [float("inf")] * 64), (907, [0.0] * 64), (908, [-0.0] * 64)]
    rows += [(1000 + i, rows[1][1]) for i in range(150)]  # a hot vector
    want = brute(rows)
    assert found(C.centroid_clusters(data(spark, rows))) == want
    assert found(C.centroid_clusters(data(spark, rows, 1))) == want
    assert C.centroid_clusters(data(spark, rows)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_few_rows_and_none(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(30)]  # equal centroids: all ties
    assert found(C.centroid_clusters(data(spark, rows))) == brute(rows)
    assert found(C.centroid_clusters(data(spark, rows[:3]))) == brute(rows[:3])
    assert C.centroid_clusters(data(spark, rows[:0])).collect() == []
    assert C.centroid_clusters(data(spark, [(1, None)])).collect() == []


def test_large_components(spark):
    g = np.random.default_rng(2)
    rows = [(i, (g.normal(size=64) * 3e4).tolist()) for i in range(60)]  # beyond what doubles can square exactly
    assert found(C.centroid_clusters(data(spark, rows))) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        C.centroid_clusters(data(spark, [(i, [1e9 * (i + 1)] * 64) for i in range(9)])).collect()


def test_loosening_bounds_every_point_of_a_sphere():
    g = np.random.default_rng(3)
    less = 0
    for _ in range(200):
        d, k = int(g.integers(2, 6)), 4
        before, after, radius = g.normal(size=(k, d)) * 3, g.normal(size=(k, d)) * 3, np.abs(g.normal(size=k))
        by = C.loosening(before, after, radius)
        drift = np.sqrt(((after - before) ** 2).sum(1))
        assert (by <= drift + 1e-12).all()
        less += (by < 0.9 * drift).sum()
        for i in range(k):
            u = g.normal(size=(500, d))
            x = before[i] + u / np.sqrt((u * u).sum(1, keepdims=True)) * radius[i] * g.random((500, 1)) ** 0.2
            for j in range(k):
                gain = np.sqrt(((x - before[j]) ** 2).sum(1)) - np.sqrt(((x - after[j]) ** 2).sum(1))
                assert gain.max() <= by[i, j] + 1e-9
    assert less > 500  # the geometry does loosen less than the drift


def test_bounds_spare_comparisons():
    g = np.random.default_rng(4)
    centres = g.normal(size=(8, 64)) * 600
    q = np.floor(centres[g.integers(0, 8, 4000)] + g.normal(size=(4000, 64)) * 60).astype(np.int64)
    c, cluster, bound, loose, plain, scans = q[:8].copy(), np.full(4000, -1), np.full(4000, -np.inf), np.zeros(8), np.full(4000, -np.inf), []
    for _ in range(10):
        cluster, near, bound, open_ = C.assign(q, cluster, bound, c, loose)
        assert (cluster == C.squared(q, c).argmin(1)).all()
        scans.append(int(open_.sum()))
        moved = np.array([np.floor(q[cluster == i].mean(0)) if (cluster == i).any() else c[i] for i in range(8)]).astype(np.int64)
        far = np.array([near[cluster == i].max(initial=0) for i in range(8)])
        by = C.loosening(c.astype(float), moved.astype(float), np.sqrt(far) * (1 + C.SLACK))
        np.fill_diagonal(by, 0)
        loose, c = by.max(1), moved
    assert scans[0] == 4000 and sum(scans[1:]) < 9 * 4000 * 0.5


def test_checkpoints_leave_no_shuffle_files(spark):
    from spectroloom.llm.common import CLEANUP, checkpointed

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (blocks.apply(i).getName() for i in range(blocks.size())) if f.startswith("shuffle_") and f.endswith(".data")}

    before, setting = shuffles(), spark.conf.get(CLEANUP)
    out = checkpointed(spark.range(0, 1000, 1, 5).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert sum(r["count"] for r in out.collect()) == 1000 and out.join(out, "k").count() == 7
