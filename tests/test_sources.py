import glob
import os

import numpy as np
import pytest

from spectroloom.functions.models import register_model
from spectroloom.operators.kmeans import CosineKMeans
from spectroloom.operators.schedule import ordered_average
from spectroloom.operators.vmf import VMFMixture
from spectroloom.sources import npy

SCHEMA = "row_id long, x array<double>"


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA).repartition(parts)


def matrix_of(df):
    rows = df.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(rows)))
    return np.array([r.x for r in rows])


def test_npy_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 5)).astype(np.float32)
    files = npy.write_npy(frame(spark, x, 7), str(tmp_path / "m"), rows=100)
    names = sorted(glob.glob(str(tmp_path / "m" / "*.npy")))
    assert files == 10 and 1 < len(names) <= 10 and len(os.listdir(tmp_path / "m")) == len(names)
    assert np.array_equal(np.concatenate([np.load(n) for n in names]), x)  # any reader sees them in order
    for rows in (30, 1 << 20):
        df = npy.read_npy(spark, str(tmp_path / "m"), rows)
        assert df.rdd.getNumPartitions() == sum(-(-len(np.load(n)) // rows) for n in names)
        assert np.array_equal(matrix_of(df), x)
    assert np.array_equal(matrix_of(npy.read_npy(spark, f"file://{names[0]}")), np.load(names[0]))
    npy.write_npy(frame(spark, x[:3]), str(tmp_path / "d"), dtype="<f8")
    assert np.array_equal(matrix_of(npy.read_npy(spark, str(tmp_path / "d"))), x[:3])


def test_npy_shapes(spark, tmp_path):
    for i, bad in enumerate((np.zeros(3), np.asfortranarray(np.ones((3, 2))), np.array([["a"]]))):
        np.save(tmp_path / f"{i}.npy", bad)
        with pytest.raises(Exception, match="row order"):
            npy.read_npy(spark, str(tmp_path / f"{i}.npy")).collect()
    (tmp_path / "w").mkdir()
    np.save(tmp_path / "w" / "a.npy", np.ones((2, 3)))
    np.save(tmp_path / "w" / "b.npy", np.zeros((0, 9)))
    np.save(tmp_path / "w" / "c.npy", np.arange(6).reshape(2, 3))
    assert matrix_of(npy.read_npy(spark, str(tmp_path / "w"))).tolist() == [[1, 1, 1], [1, 1, 1], [0, 1, 2], [3, 4, 5]]
    np.save(tmp_path / "w" / "d.npy", np.ones((1, 4)))
    with pytest.raises(Exception, match="values"):
        npy.read_npy(spark, str(tmp_path / "w")).collect()
    (tmp_path / "none").mkdir()
    assert npy.read_npy(spark, str(tmp_path / "none")).collect() == []
    npy.write_npy(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert npy.read_npy(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception):
        npy.write_npy(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), str(tmp_path / "ragged"))
    assert not glob.glob(str(tmp_path / "ragged" / "*.npy"))


def test_iterables_of_batches(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(25, 3))
    batches = (x[i : i + 4] if i % 8 else (x[i : i + 4], "label") for i in range(0, 25, 4))
    assert np.array_equal(matrix_of(npy.from_batches(spark, batches, str(tmp_path / "b"))), x)
    with pytest.raises(ValueError):
        npy.from_batches(spark, [np.zeros(3)], str(tmp_path / "c"))


def test_positions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).selectExpr("id * 3 AS v").write.parquet(path)
    want = [v for f in sorted(glob.glob(f"{path}/*.parquet")) for v in spark.read.parquet(f).toArrow().column("v").to_pylist()]
    for size in ("1g", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = npy.with_positions(spark, path).orderBy("row_id").collect()
        assert [r.row_id for r in rows] == list(range(1000)) and [r.v for r in rows] == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        npy.with_positions(spark, path, "v")
    spark.range(0).write.parquet(str(tmp_path / "e"))
    assert npy.with_positions(spark, str(tmp_path / "e")).collect() == []


def fold(values, decay):
    out = values[0]
    for v in values[1:]:
        out = decay * out + (1 - decay) * v
    return out


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_ordered_average(spark, blocks):
    g = np.random.default_rng(3)
    rows = [(k, int(t), float(g.normal()), "z") for k in ("a", "b", None) for t in g.permutation({"a": 5000, "b": 7, None: 30}[k])]
    rows += [("c", 1, None, "z"), ("d", 2, 4.0, "z"), ("a", 99999, None, "z"), ("e", 1, 2.0, "z"), ("e", 1, 1.0, "z"), ("e", 1, 1.0, "z")]
    df = spark.createDataFrame(rows, "k string, t long, value double, n string").repartition(6)
    series = {}
    for k, t, v, _ in rows:
        if v is not None:
            series.setdefault(k, []).append((t, v))
    for decay in (0.0, 0.9, 0.999):
        got = {r.k: (r.n, r.average) for r in ordered_average(df, ["k"], ["t"], "value", decay, blocks).collect()}
        assert set(got) == set(series)
        for k, own in series.items():
            assert got[k][0] == len(own) and got[k][1] == pytest.approx(fold([v for _, v in sorted(own)], decay), abs=1e-10)
    everything = [v for _, _, v in sorted((k is not None, k or "", v) for k, t, v, _ in rows if v is not None)]
    whole = ordered_average(df, [], ["value"], "value", 0.9, blocks).collect()
    assert len(whole) == 1 and whole[0].n == len(everything) and whole[0].average == pytest.approx(fold(sorted(everything), 0.9), abs=1e-10)
    assert ordered_average(df.limit(0), ["k"], ["t"]).collect() == [] and ordered_average(df.limit(0), [], ["t"]).collect() == []
    with pytest.raises(ValueError):
        ordered_average(df, [], ["t"], decay=1.0)


def test_models_in_sql(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(60, 4))
    df = frame(spark, x).unionAll(spark.createDataFrame([(900, None), (901, [1.0, None, 1.0, 1.0])], SCHEMA))
    means, mixture = CosineKMeans(3).fit(frame(spark, x)), VMFMixture(2, max_iter=5).fit(frame(spark, x))
    means.save_centroids(spark, str(tmp_path / "k"))
    mixture.save(spark, str(tmp_path / "m"))
    df.createOrReplaceTempView("given_rows")
    assert register_model(spark, "cluster_of", str(tmp_path / "k")) == "kmeans" and register_model(spark, "component_of", str(tmp_path / "m")) == "vmf"
    got = spark.sql("SELECT row_id, cluster_of(x) AS c, component_of(x) AS label, component_of_gamma(x) AS gamma, component_of_loglik(x) AS loglik FROM given_rows ORDER BY row_id").collect()
    assert {r.row_id: r.c for r in got} == {r.row_id: r.label for r in means.predict(df).collect()}
    want = mixture.predict_proba(df).orderBy("row_id").collect()
    assert [(r.label, r.gamma, r.loglik) for r in got] == [(r.label, r.gamma, r.loglik) for r in want]
    assert {r.n for r in spark.sql("SELECT cluster_of(x) AS c, count(*) AS n FROM given_rows WHERE cluster_of(x) = 1 GROUP BY 1").collect()} == {sum(r.c == 1 for r in got)}
    with pytest.raises(KeyError):
        register_model(spark, "nothing", str(tmp_path / "none"))
