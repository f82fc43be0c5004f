import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectroloom.functions import rng
from spectroloom.functions import vectors as V
from spectroloom.operators.augment import SpectraAugmenter, SpectraAugmenterConfig
from spectroloom.operators.kmeans import CosineKMeans, elbow_ckmeans, fit_models
from spectroloom.operators.masks import evaluate, fixed_visible, masked_mse, masked_sse, patch_aligned, patch_mask
from spectroloom.operators.matrix import unit, validate
from spectroloom.operators.network import AutoencoderConfig, MaskedAutoencoder, load_weights, save_weights
from spectroloom.operators.optim import EMA, AdamW, decays
from spectroloom.operators.preprocess import SNVScaler, cosine_fps_downsample, grouped_fps, sample_size
from spectroloom.operators.quality import silhouette_samples_cosine, silhouette_score_cosine
from spectroloom.operators.schedule import moving_average, warmup_cosine
from spectroloom.operators.selection import elbows, find_elbow_curvature, plot_elbow_ckm, plot_elbow_vmf
from spectroloom.operators.vmf import VMFMixture, elbow_vmf, log_bessel, vmf_bessel_ratio
from spectroloom.sources.spectra import append_history, read_history, spectra
from spectroloom.streaming import score

SCHEMA = "row_id long, x array<double>"


def frame(spark, x, extra=None, schema=""):
    rows = [(i, [float(v) for v in row], *(() if extra is None else (extra[i],))) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA + schema).repartition(3)


def blobs(seed=0, sizes=(30, 25, 20), d=8, noise=0.15):
    g = np.random.default_rng(seed)
    centres = unit(g.normal(size=(len(sizes), d)))
    x = np.concatenate([unit(c + noise * g.normal(size=(n, d))) for c, n in zip(centres, sizes)])
    return x, np.repeat(np.arange(len(sizes)), sizes)


def test_snv_and_back(spark):
    df = frame(spark, [[1, 2, 3, 4], [5, 7, 7, 11]])
    scaler = SNVScaler(transform_stats=True)
    out = scaler.transform(df)
    for r in out.collect():
        assert abs(np.mean(r.y)) < 1e-6 and abs(np.std(r.y, ddof=1) - 1) < 1e-6
    for r in scaler.inverse_transform(out, output="back").collect():
        assert np.allclose(r.back, r.x, atol=1e-6)


def test_snv_of_single_value_and_constant(spark):
    out = {r.row_id: r.y for r in SNVScaler().transform(frame(spark, [[5.0]])).collect()}
    assert math.isfinite(out[0][0])
    assert max(abs(v) for v in SNVScaler().transform(frame(spark, [[3, 3, 3]])).first().y) < 1e-3


def test_rng_is_uniform_and_repeatable(spark):
    df = spark.range(4000).repartition(7)
    u = df.select("id", rng.uniform(rng.digest(1, F.col("id"), "a")).alias("u"), rng.normal(rng.digest(1, F.col("id"), "b")).alias("z"))
    a, b = (dict((r.id, (r.u, r.z)) for r in x.collect()) for x in (u, u.coalesce(1)))
    assert a == b
    us, zs = np.array(list(a.values())).T
    assert abs(us.mean() - 0.5) < 0.02 and abs(zs.mean()) < 0.06 and abs(zs.std() - 1) < 0.05


def test_validate_rejects(spark):
    for bad in ([[1.0, float("nan")]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            validate(frame(spark, bad))
    with pytest.raises(ValueError):
        validate(spark.createDataFrame([], SCHEMA))


def test_fps_on_a_circle(spark):
    x = [[math.cos(a), math.sin(a)] for a in np.arange(8) * math.pi / 4]
    got = cosine_fps_downsample(frame(spark, x), ratio=0.25, init=0).orderBy("rank").collect()
    assert [r.row_id for r in got] == [0, 4]
    assert cosine_fps_downsample(spark.createDataFrame([], SCHEMA), init=0).count() == 0
    with pytest.raises(ValueError):
        cosine_fps_downsample(frame(spark, x), init=999)
    assert [sample_size(10, r) for r in (0, 0.1, 0.25, 1)] == [1, 1, 2, 10]


@pytest.mark.parametrize("start", [{"init": 37}, {"seed": 5}])
def test_large_fps_equals_steps(spark, monkeypatch, start):
    x = np.random.default_rng(8).normal(size=(150, 6))
    x[20:24] = x[20]  # ties
    rows = lambda: [tuple(r)[:2] for r in cosine_fps_downsample(frame(spark, x), k=20, **start).orderBy("rank").collect()]
    steps = rows()
    monkeypatch.setattr("spectroloom.operators.preprocess.STEPS", 3)
    assert rows() == steps and len(steps) == 20


def test_grouped_fps_equals_steps(spark):
    x, y = blobs()
    df = frame(spark, x, y.tolist(), ", g int")
    got = [(r.group, r.rank, r.row_id) for r in grouped_fps(df, "g", ratio=0.2).orderBy("group", "rank").collect()]
    want = []
    for g in range(3):
        own = df.where(F.col("g") == g)
        first = own.agg(F.min("row_id")).first()[0]
        want += [(str(g), r["rank"], r["row_id"]) for r in cosine_fps_downsample(own, ratio=0.2, init=first).orderBy("rank").collect()]
    assert got == want


def test_large_groups_are_sampled_in_rounds(spark, monkeypatch):
    import spectroloom.operators.preprocess as P

    x, y = blobs(sizes=(60, 25, 20))
    x = np.concatenate([x, x[:20]])  # ties
    df = frame(spark, x, [*y.tolist(), *y[:20].tolist()], ", g int").withColumn("g", F.expr("nullif(g, 1)"))
    rows = lambda: [tuple(r)[:3] for r in grouped_fps(df, "g", ratio=0.3).orderBy("group", "rank").collect()]
    want = rows()
    monkeypatch.setattr(P, "TILE_VALUES", 23 * 8)
    monkeypatch.setattr(P, "CANDIDATES", 12)
    assert rows() == want


def test_kmeans_finds_blobs_on_any_partitioning(spark):
    x, y = blobs()
    df = frame(spark, x)
    a, b = (CosineKMeans(3, random_state=7).fit(d) for d in (df, df.coalesce(1)))
    assert np.allclose(a.centroids, b.centroids) and abs(a.inertia_ - b.inertia_) < 1e-12
    label = {r.row_id: r.label for r in a.predict(df).collect()}
    assert len({(int(k), label[i]) for i, k in enumerate(y)}) == 3
    assert np.allclose(np.linalg.norm(a.centroids, axis=1), 1)
    assert a.final_inertia(df) <= a.inertia_ + 1e-12


def test_kmeans_repairs_empty_clusters(spark):
    x, _ = blobs()
    start = np.stack([x[0], x[0], x[0]])
    centroids, _, _ = fit_models(frame(spark, x), {0: start}, 1e-4, 30)[0]
    sizes = np.bincount((x @ centroids.T).argmax(1), minlength=3)
    assert (sizes > 0).all()


def test_kmeans_errors_and_files(spark, tmp_path):
    x, _ = blobs()
    df = frame(spark, x)
    with pytest.raises(ValueError):
        CosineKMeans(0)
    with pytest.raises(RuntimeError):
        CosineKMeans(2).predict(df)
    with pytest.raises(ValueError):
        CosineKMeans(100).fit(df)
    model = CosineKMeans(3).fit(df)
    model.save_centroids(spark, str(tmp_path / "c"))
    assert np.allclose(CosineKMeans(3).load_centroids(spark, str(tmp_path / "c")).centroids, model.centroids)
    with pytest.raises(ValueError):
        CosineKMeans(4).load_centroids(spark, str(tmp_path / "c"))
    assert CosineKMeans(4).load_centroids(spark, str(tmp_path / "c"), strict_k=False).n_components == 3


def test_elbow(spark):
    k, at, bend = find_elbow_curvature([1, 2, 3, 4, 5, 6], [0.9, 0.7, 0.75, 0.6, 0.59, 0.58])
    assert (k, at) == (3, 2) and abs(bend - 0.91636) < 1e-4
    assert find_elbow_curvature([1, 2, 3, 4, 5, 6], [500, 410, 360, 340, 335, 334])[0] == 5
    with pytest.raises(ValueError):
        find_elbow_curvature([1, 2], [1.0, 0.5])
    assert [tuple(r) for r in plot_elbow_vmf(spark, [1, 2], [3.0, 2.0], 1, "nll").collect()] == [(1, 3.0, False, "nll"), (2, 2.0, True, "nll")]
    assert plot_elbow_ckm(spark, [1], [3.0], 0).first().criterion == "inertia"
    x, _ = blobs(3, (40, 40, 40), noise=0.05)
    ks, inertias, *_ = elbow_ckmeans(frame(spark, x), 5)
    assert ks == [1, 2, 3, 4, 5] and inertias[2] < inertias[0]
    assert abs(inertias[1] - CosineKMeans(2).fit(frame(spark, x)).inertia_) < 1e-12


def curve_bend(k, scores, window=5, degree=2, smooth=True):
    """The rule for one curve, polynomial by polynomial."""
    x, y = np.array(k, float), np.minimum.accumulate(np.array(scores, float))
    x, y, n = (x - x.min()) / (np.ptp(x) + 1e-12), (y - y.min()) / (np.ptp(y) + 1e-12), len(x)
    if smooth and n >= 5:
        w = max(5, min(window | 1, n if n % 2 else n - 1))
        dx, d1, d2 = np.median(np.diff(x)), [], []
        for i in range(n):
            lo = min(max(i - w // 2, 0), n - w)
            p = np.polynomial.Polynomial.fit(np.arange(w), y[lo : lo + w], max(2, min(degree, w - 1)))
            d1.append(p.deriv(1)(i - lo) / dx)
            d2.append(p.deriv(2)(i - lo) / dx**2)
        d1, d2 = np.array(d1), np.array(d2)
    else:
        d1 = np.gradient(y, x)
        d2 = np.gradient(d1, x)
    bend = np.abs(d2) / (1 + d1 * d1) ** 1.5
    return bend[1:-1]


def test_elbows_of_many_curves(spark):
    g = np.random.default_rng(5)
    curves, rows = {}, []
    for c in range(40):
        n = int(g.integers(1, 16))
        k = np.sort(g.choice(40, n, replace=False)).tolist() if c % 2 else list(range(1, n + 1))
        curves[c] = (k, (np.sort(g.random(n))[::-1] + g.normal(size=n) * 0.05).tolist())
        rows += [(c, float(a), float(b), 1) for a, b in zip(*curves[c])]
    odd = [(0, None, 0.1, 1), (1, 3.0, None, 1), (2, 4.0, float("nan"), 1), (3, float("inf"), 0.0, 1), (90, 1.0, 1.0, 1), (90, 2.0, 1.0, 1), (90, 3.0, 1.0, 1)]
    odd += [(7, float(curves[7][0][0]), curves[7][1][0] + 9.0, 1)]  # a k with two scores
    for smooth, window, degree in ((True, 5, 2), (True, 9, 3), (False, 5, 2), (True, 4, 2)):
        df = elbows(spark.createDataFrame(rows + odd, "c int, k double, s double, n int").repartition(5), ["c"], "k", "s", smooth, window, degree)
        assert df.columns == ["c", "k", "s", "n", "curvature", "is_elbow"]
        found = df.collect()
        assert len(found) == len(rows) + len(odd)
        for c, (k, s) in curves.items():
            own = sorted((r for r in found if r.c == c and r.curvature is not None), key=lambda r: r.k)
            if len(k) < 3:
                assert not own and not any(r.is_elbow for r in found if r.c == c)
                continue
            want = curve_bend(k, s, window, degree, smooth)
            assert np.allclose([r.curvature for r in own], want, rtol=1e-6, atol=1e-6)
            assert [r.k for r in own if r.is_elbow] == [k[1 + int(want.argmax())]]
            alone = find_elbow_curvature(k, s, smooth, window, degree)
            assert alone[:2] == (k[1 + int(want.argmax())], 1 + int(want.argmax())) and alone[2] == pytest.approx(want.max(), rel=1e-6)
        assert [r.k for r in found if r.c == 90 and r.is_elbow] == [2.0]  # a flat curve: the first inner point
    with pytest.raises(ValueError):
        elbows(spark.createDataFrame(rows, "c int, k double, _x double, n int"), ["c"], "k", "_x")
    assert elbows(spark.createDataFrame([], "c int, k double, s double"), ["c"], "k", "s").collect() == []


def brute_silhouette(x, y):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    d = 1 - u @ u.T
    out = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][y == k].mean() for k in set(y) - {y[i]})
        out.append((b - a) / max(a, b, 1e-12))
    return np.array(out)


def test_silhouette(spark):
    x, y = blobs(5)
    x[3] = 0
    y = y * 10 + 7
    y[-1] = 99
    df = frame(spark, x, y.tolist(), ", label long")
    got = {r.row_id: r.silhouette for r in silhouette_samples_cosine(df).collect()}
    want = brute_silhouette(x, y)
    # a zero row's own mean counts itself as 0, so its distance to others is 1 as in the brute force
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)
    assert got[len(x) - 1] == 0.0
    assert abs(silhouette_score_cosine(df) - want.mean()) < 1e-9
    one = frame(spark, x[:4], [1] * 4, ", label long")
    assert all(math.isnan(r.silhouette) for r in silhouette_samples_cosine(one).collect())


def test_vmf(spark, tmp_path):
    x, y = blobs(7, (40, 30, 30), d=10, noise=0.1)
    df = frame(spark, x)
    model = VMFMixture(3).fit(df)
    rows = model.predict_proba(df).collect()
    assert all(abs(sum(r.gamma) - 1) < 1e-9 for r in rows)
    assert len({(int(y[r.row_id]), r.label) for r in rows}) == 3
    assert np.allclose(np.linalg.norm(model.parameters[0], axis=1), 1) and (model.parameters[1] > 0).all()
    model.save(spark, str(tmp_path / "m"))
    again = VMFMixture.load(spark, str(tmp_path / "m"))
    assert abs(again.loglik(df) - model.loglik(df)) < 1e-6 and abs(again.bic(df) - model.bic(df)) < 1e-6
    assert model.num_params() == 3 * 10 + 2
    with pytest.raises(RuntimeError):
        VMFMixture(2).predict(df)
    for bad in ({"n_components": 0}, {"n_components": 2, "init": "x"}, {"n_components": 2, "kappa_init": 0}):
        with pytest.raises(ValueError):
            VMFMixture(**bad)
    assert VMFMixture(2, init="random", max_iter=2).fit(df).d == 10
    ks, scores, elbow, _, _, best = elbow_vmf(df, 4, max_iter=20)
    assert best == ks[int(np.argmin(scores))] and elbow in ks


def test_bessel():
    nu, k = 0.5, np.array([0.5, 1.0, 30.0])
    exact = np.log(np.sqrt(2 / (np.pi * k)) * np.sinh(k))
    assert np.allclose(log_bessel(nu, k), exact, atol=1e-2)
    r = vmf_bessel_ratio(nu, np.array([0.1, 5.0, 100.0]))
    assert (np.diff(r) > 0).all() and 0 < r.min() < r.max() < 1


def test_masks(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id").withColumn("m", patch_mask(F.col("row_id"), 64, 16, 5))
    rows = df.withColumn("ok", patch_aligned(F.col("m"), 16)).collect()
    assert all(sum(r.m) == 5 * 4 and len(r.m) == 64 and r.ok for r in rows) and len({tuple(r.m) for r in rows}) > 10
    assert sum(df.select(patch_mask(F.col("row_id"), 8, 4, 0).alias("m")).first().m) == 0
    assert all(df.select(patch_mask(F.col("row_id"), 8, 4, 4).alias("m")).first().m)
    for bad in ((10, 4, 1), (8, 4, 5)):
        with pytest.raises(ValueError):
            patch_mask(F.col("row_id"), *bad)


def test_losses(spark):
    x = np.arange(24).reshape(3, 8) / 10
    rows = [(i, i // 2, x[i].tolist(), (x[i] + 0.5).tolist(), [k < 4 for k in range(8)]) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id long, batch_id long, x array<double>, x_recon array<double>, masked array<boolean>")
    value = lambda r: masked_sse(df, reduction=r).first().loss
    assert abs(value("sum") - 3.0) < 1e-9 and abs(value("mean") * 12 - value("sum")) < 1e-9 and abs(value("batch_mean") * 3 - value("sum")) < 1e-9
    assert masked_mse(df.withColumn("masked", F.transform("x", lambda _: F.lit(False)))).first().loss == 0.0
    assert abs(evaluate(df, "sse", "sum").first().loss - (2.0 * 2 + 1.0 * 1) / 3) < 1e-9
    assert masked_sse(df.limit(0)).first().loss == 0.0
    with pytest.raises(ValueError):
        masked_sse(df, reduction="median")
    assert fixed_visible(df, [True] * 4 + [False] * 4).first().masked == [False] * 4 + [True] * 4
    with pytest.raises(TypeError):
        fixed_visible(df, [1, 0])


def test_augmenter(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(12, 16))
    x = unit(x - x.mean(1, keepdims=True))
    df = frame(spark, x)
    config = SpectraAugmenterConfig(shift_prob=0, noise_prob=1, noise_angle_deg_range=(2, 2), shuffle_order_per_batch=False)
    out = {r.row_id: np.array(r.x) for r in SpectraAugmenter(config).transform(df).collect()}
    for i, v in out.items():
        assert abs(np.degrees(np.arccos(np.clip(v @ x[i], -1, 1))) - 2) < 1e-4
        assert abs(v.mean()) < 1e-9 and abs(np.linalg.norm(v) - 1) < 1e-9
    shifted = SpectraAugmenter(SpectraAugmenterConfig(shift_prob=1, noise_prob=0)).transform(df).collect()
    assert all(abs(np.linalg.norm(r.x) - 1) < 1e-9 and not np.allclose(r.x, x[r.row_id]) for r in shifted)
    for same in (SpectraAugmenter().transform(df, training=False), SpectraAugmenter(SpectraAugmenterConfig(shift_prob=0, noise_prob=0)).transform(df)):
        assert all(np.allclose(r.x, x[r.row_id]) for r in same.collect())
    for bad in ({"shift_prob": 1.5}, {"noise_prob": -0.1}, {"shift_delta_range": (2, -2)}, {"noise_angle_deg_range": (-1, 3)}, {"noise_angle_deg_range": (0, 200)}, {"eps": 0.0}):
        with pytest.raises(ValueError):
            SpectraAugmenterConfig(**bad)


def test_fractional_shift(spark):
    df = frame(spark, [[0, 1, 2, 3]])
    got = df.select(V.fractional_shift(F.col("x"), F.lit(0.5)).alias("a"), V.fractional_shift(F.col("x"), F.lit(-9.0)).alias("b")).first()
    assert got.a == [0, 0.5, 1.5, 2.5] and got.b == [3, 3, 3, 3]


def test_network(spark, tmp_path):
    c = AutoencoderConfig(seq_len=16, n_patches=4, d_model=16, nhead=4, num_layers=1, dim_feedforward=32, latent_dim=8)
    x = np.random.default_rng(0).normal(size=(6, 16))
    df = frame(spark, x)
    model = MaskedAutoencoder(c)
    z = {r.row_id: np.array(r.z) for r in model.encode(df).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in z.values())
    hidden = df.withColumn("visible", F.transform("x", lambda _, i: i < 8))
    changed = hidden.withColumn("x", F.transform("x", lambda v, i: F.when(i < 8, v).otherwise(v + 100)))
    a, b = ({r.row_id: r.z for r in model.encode(d, visible="visible").collect()} for d in (hidden, changed))
    assert all(np.allclose(a[i], b[i]) for i in a)
    assert len(model.reconstruct(df).first().x_recon) == 16
    save_weights(str(tmp_path / "w"), c, model.weights, spark)
    again = MaskedAutoencoder(*load_weights(str(tmp_path / "w"), spark))
    assert all(np.allclose(r.z, z[r.row_id]) for r in again.encode(df).collect())
    with pytest.raises(ValueError):
        AutoencoderConfig(seq_len=10, n_patches=4)


def test_schedule_and_averages(spark):
    lr = [r.v for r in spark.range(10).select(warmup_cosine(F.col("id"), 2, 10, 0.2).alias("v")).collect()]
    assert lr[:2] == [0.5, 1.0] and all(0.2 <= v <= 1 for v in lr) and lr[2] == 1.0
    assert abs(spark.range(1).select(moving_average(F.array(F.lit(1.0), F.lit(2.0)), 0.9).alias("v")).first().v - 1.1) < 1e-12
    w = {"a.weight": np.ones((2, 2)), "a.bias": np.ones(2)}
    before = {k: v.copy() for k, v in w.items()}
    ema = EMA(w, 0.5)
    AdamW(w, lr=0.1).step({k: np.ones_like(v) for k, v in w.items()})
    ema.update(w)
    assert (w["a.weight"] < before["a.weight"]).all() and np.allclose(ema.shadow["a.bias"], (before["a.bias"] + w["a.bias"]) / 2)
    assert decays("a.weight") and not decays("a.bias") and not decays("cls_token")


def test_spectra_history_and_stream(spark, tmp_path):
    long = spark.createDataFrame([(1, 0, 2.0), (1, 0, 3.0), (1, 2, 1.0), (2, 1, 4.0)], "id long, c int, v double")
    got = {r.row_id: r.x for r in spectra(long, "id", F.col("c"), F.sum("v"), 3).collect()}
    assert got == {1: [5.0, 0.0, 1.0], 2: [0.0, 4.0, 0.0]}
    for k in range(2):
        append_history(spark, str(tmp_path / "h"), "run", {"epoch": k})
    append_history(spark, str(tmp_path / "h"), "other", {"epoch": 9})
    assert sorted(r["epoch"] for r in read_history(spark, str(tmp_path / "h"), "run")) == [0, 1]
    x, _ = blobs()
    df = frame(spark, x)
    df.write.parquet(str(tmp_path / "in"))
    model = CosineKMeans(3).fit(SNVScaler().transform(df).select("row_id", F.col("y").alias("x")))
    scored = score.score_stream(score.read_stream(spark, str(tmp_path / "in"), df), model)
    score.write_stream(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {r.row_id: r.label for r in model.predict(SNVScaler().transform(df), x="y").collect()}
    assert {r.row_id: r.label for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_channels_of_null_and_wild_records(spark):
    import datetime

    from spectroloom.sources.spectra import spectra

    day = datetime.datetime(2020, 3, 1)
    df = spark.createDataFrame([(1, day, 2.0), (1, None, 5.0), (None, day, 7.0), (2, None, 1.0)], "k long, at timestamp, v double")
    got = spectra(df, "k", F.month("at") - 1, F.sum("v"), 12).collect()
    assert [(r.row_id, r.x) for r in got] == [(1, [0.0, 0.0, 2.0] + [0.0] * 9)]
    with pytest.raises(Exception, match="channel"):
        spectra(df, "k", F.month("at") + 20, F.sum("v"), 12).collect()


def test_silhouettes_of_null_rows(spark):
    from spectroloom.operators.quality import silhouette_samples_cosine

    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 1)]
    odd = [(4, None, 0), (5, [1.0, 0.0], None), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 9)]
    schema = "row_id long, x array<double>, label long"
    want = {r.row_id: r.silhouette for r in silhouette_samples_cosine(spark.createDataFrame(rows, schema)).collect()}
    got = {r.row_id: r.silhouette for r in silhouette_samples_cosine(spark.createDataFrame(rows + odd, schema)).collect()}
    assert got == want | {k: None for k, _, _ in odd}
    assert [r.silhouette for r in silhouette_samples_cosine(spark.createDataFrame(odd, schema)).collect()] == [None] * 4
    assert silhouette_samples_cosine(spark.createDataFrame([], schema)).count() == 0


def test_visible_masks_by_row(spark):
    from spectroloom.operators.masks import fixed_visible

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "row_id long, x array<double>")
    masks = spark.createDataFrame([(2, [False, True]), (1, [True, True])], "row_id long, visible array<boolean>")
    got = {r.row_id: (r.visible, r.masked) for r in fixed_visible(rows, masks).collect()}
    assert got == {1: ([True, True], [False, False]), 2: ([False, True], [True, False])}
    with pytest.raises(Exception, match="mask"):
        fixed_visible(rows, masks.where("row_id = 1")).collect()
