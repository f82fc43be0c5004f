"""Models beyond a task's size, on any partitioning, saved in versions and resumed."""

import json
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectroloom.operators import exact, nearest
from spectroloom.operators import kmeans as K
from spectroloom.operators import matrix as M
from spectroloom.operators import vmf
from spectroloom.operators.kmeans import CosineKMeans, elbow_ckmeans, seed_centroids
from spectroloom.operators.quality import silhouette_samples_cosine
from spectroloom.operators.vmf import VMFMixture, bottom_rows, elbow_vmf, start_rows
from spectroloom.sources import versions

SCHEMA = "row_id long, x array<double>"


def data(n=90, d=6, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(4, d))[g.integers(0, 4, n)] + 0.3 * g.normal(size=(n, d))
    x[5], x[7] = x[6], 0.0  # a copy and a zero row
    return x


def frame(spark, x, extra=None, schema="", parts=3):
    rows = [(i, [float(v) for v in row], *(() if extra is None else (extra[i],))) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA + schema).repartition(parts)


def test_limbs_are_exact_sums():
    g = np.random.default_rng(1)
    x = np.r_[g.normal(size=2000) / 4, 2.0 ** -g.integers(0, 60, 200), -1.0, 1.0, 0.0]
    cut = [sum(Fraction(int(v), 1 << exact.BITS * (i + 1)) for i, v in enumerate(column)) for column in exact.limbs(x).T]
    assert all(abs(c - Fraction(v)) <= Fraction(1, 1 << 54) for c, v in zip(cut, x.tolist()))
    for order in (np.arange(len(x)), g.permutation(len(x))):
        parts = [exact.limbs(p).sum(1) for p in np.array_split(x[order], 7)]
        assert exact.value(sum(parts)[:, None])[0] == float(sum(cut))
    big = g.normal(size=500) * 1e6
    assert abs(exact.value(exact.limbs(big, 4, 32).sum(1)[:, None], 32)[0] - float(sum(map(Fraction, big.tolist())))) < 1e-6


def test_dots_do_not_depend_on_the_batch():
    g = np.random.default_rng(2)
    for d in (3, 64, 500):
        u, c = M.unit(g.normal(size=(301, d))), M.unit(g.normal(size=(9, d)))
        whole = exact.dots(u, c)
        assert np.abs(whole - u @ c.T).max() < 1e-12
        assert all((exact.dots(u[i : i + n], c[j : j + 2]) == whole[i : i + n, j : j + 2]).all() for i, n, j in ((0, 1, 0), (7, 13, 4), (300, 1, 7)))


def test_weighted_sums_in_any_pieces():
    g = np.random.default_rng(3)
    w, u = g.random((5000, 3)), M.unit(g.normal(size=(5000, 4)))
    whole = exact.weighted_value(exact.weighted(w, u))
    assert np.abs(whole - w.T @ u).max() < 1e-8
    order = g.permutation(5000)
    assert (exact.weighted_value(sum(exact.weighted(w[p], u[p]) for p in np.array_split(order, 11))) == whole).all()


def test_fits_are_the_same_bits_on_any_partitioning(spark):
    x = data(400)
    fits = [CosineKMeans(4, max_iter=6, tol=0.0).fit(frame(spark, x, parts=p)) for p in (3, 7, 50)]
    assert len({(f.centroids.tobytes(), f.inertia_, f.n_iter_) for f in fits}) == 1
    assert len({f.final_inertia(frame(spark, x, parts=p)) for f, p in zip(fits, (2, 9, 31))}) == 1
    mixtures = [VMFMixture(3, max_iter=4, tol=0.0).fit(frame(spark, x[8:], parts=p)) for p in (3, 7, 50)]
    assert len({(*(p.tobytes() for p in m.parameters), m.lower_bound_) for m in mixtures}) == 1
    assert len({(m.loglik(frame(spark, x, parts=p)), m.bic(frame(spark, x, parts=p))) for m, p in zip(mixtures, (2, 9, 31))}) == 1


@pytest.mark.parametrize("limit", [40, 150])
def test_more_centroids_than_a_task_may_hold(spark, monkeypatch, limit):
    x = data()
    df = frame(spark, x).unionAll(spark.createDataFrame([(900, x[3].tolist())] * 40 + [(901, None), (902, [None] * 6), (903, [float("nan")] * 6)], SCHEMA))
    model = CosineKMeans(21)
    model.centroids = M.unit(np.r_[x[10:30], x[10:11]])  # the last equals the first: ties
    key = lambda r: (r.row_id, str(r))
    want = sorted(model.predict(df, return_dist=True).collect(), key=key)
    one = K.lloyd_pass(frame(spark, x), {0: model.centroids, 1: model.centroids[:3]})
    far = K._farthest(frame(spark, x), model.centroids, 5)
    fit = CosineKMeans(21, max_iter=3, tol=0.0).fit(frame(spark, x), init=np.r_[x[10:30], x[10:11]])
    monkeypatch.setattr(M, "MAX_BROADCAST_VALUES", limit)
    monkeypatch.setattr(nearest, "ROW_VALUES", 100)
    got = sorted(model.predict(df, return_dist=True).collect(), key=key)
    labels = lambda found: sorted(((r.row_id, r.label) for r in found), key=str)
    assert labels(got) == labels(want) == labels(model.predict(df).collect())
    for a, b in zip(got, want):
        assert (a.dist is None) == (b.dist is None) and (a.dist is None or np.array_equal(a.dist, b.dist))
    blocked = K.lloyd_pass(frame(spark, x), {0: model.centroids, 1: model.centroids[:3]})
    for m in one:
        assert all(np.array_equal(p, q) for p, q in zip(one[m], blocked[m]))
    assert np.array_equal(K._farthest(frame(spark, x), model.centroids, 5), far)
    again = CosineKMeans(21, max_iter=3, tol=0.0).fit(frame(spark, x), init=np.r_[x[10:30], x[10:11]])
    assert np.array_equal(again.centroids, fit.centroids) and again.inertia_ == fit.inertia_


def test_silhouettes_with_any_number_of_labels(spark, monkeypatch):
    x = data(150)
    labels = [int(v) for v in np.random.default_rng(4).integers(0, 40, 150)]
    labels[0], labels[1] = 777, -5  # alone in their clusters
    df = frame(spark, x, labels, ", label long").unionAll(spark.createDataFrame([(900, x[3].tolist(), labels[3])] * 30 + [(901, None, 3), (902, x[3].tolist(), None)], SCHEMA + ", label long"))
    single = frame(spark, x[:20], [4] * 20, ", label long")
    score = lambda d: sorted((r.row_id, r.label, "nan" if r.silhouette is not None and r.silhouette != r.silhouette else r.silhouette and round(r.silhouette, 11)) for r in silhouette_samples_cosine(d).where("label is not null").collect())
    want, alone = score(df), score(single)
    monkeypatch.setattr(M, "MAX_BROADCAST_VALUES", 60)
    monkeypatch.setattr(nearest, "ROW_VALUES", 300)
    assert [r for r in score(df) if r[2] is not None] == [r for r in want if r[2] is not None] and len(want) == 181
    assert score(single) == alone and {r[2] for r in alone} == {"nan"}
    assert silhouette_samples_cosine(df.limit(0)).collect() == []


def test_sums_of_many_clusters_in_a_batch(monkeypatch):
    g = np.random.default_rng(7)
    u, label = M.unit(g.normal(size=(500, 4))), g.integers(0, 40, 500)
    label[:40] = np.arange(40)
    few = K._of_clusters(exact.limbs(u), g.random(500), label, 40)
    g = np.random.default_rng(7)
    g.normal(size=(500, 4)), g.integers(0, 40, 500)
    monkeypatch.setattr(K, "FEW", 3)
    assert np.array_equal(K._of_clusters(exact.limbs(u), g.random(500), label, 40), few)
    assert np.allclose(exact.value(few[:, :-1].reshape(40, 3, 5)[7][:, :4]), u[label == 7].sum(0), atol=1e-14) and few[7, -1] == (label == 7).sum()


def test_ragged_and_null_rows(spark):
    with pytest.raises(ValueError):
        M.matrix(pa.array([[0.0, 1.0, 9.0], [1.0], [1.0, 0.0]]))
    with pytest.raises(ValueError):
        M.matrix(pa.array([[0.0], None]))
    good, rows = M.usable_matrix(pa.array([[1.0, 2.0], None, [None, 1.0], [3.0, float("inf")], [5.0, 6.0]]), 2)
    assert good.tolist() == [True, False, False, False, True] and rows.tolist() == [[1, 2], [5, 6]]
    model, mixture = CosineKMeans(2), VMFMixture(2, 2)
    model.centroids = np.eye(2)
    mixture.parameters = np.eye(2), np.full(2, 10.0), np.log(np.full(2, 0.5))
    bad = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0])], SCHEMA).coalesce(1)
    assert {r.row_id: r.label for r in model.predict(bad).collect()} == {1: 1, 2: None, 3: None, 4: None, 5: 0}
    assert [r.dist is None for r in model.predict(bad, return_dist=True).orderBy("row_id").collect()] == [False, True, True, True, False]
    got = mixture.predict_proba(bad).orderBy("row_id").collect()
    assert [r.label for r in got] == [1, None, None, None, 0] and [r.loglik is None for r in got] == [False, True, True, True, False]
    assert mixture.loglik(bad, average=True) == pytest.approx(np.mean([r.loglik for r in got if r.loglik is not None]), abs=1e-9)
    ragged = spark.createDataFrame([(1, [0.0, 1.0, 9.0]), (2, [1.0]), (3, [1.0, 0.0])], SCHEMA).coalesce(1)
    for call in (model.predict, mixture.predict_proba, model.final_inertia):
        with pytest.raises(Exception, match="values"):
            out = call(ragged)
            out.collect()


def test_versions_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "model")
    rows = lambda v: spark.createDataFrame([(v,)], "v int")
    assert versions.latest(spark, path) is None
    assert [versions.publish(rows(v), path, {"v": v}) for v in (1, 2)] == [1, 2]
    rows(3).write.parquet(f"{path}/version-left-by-a-dead-writer")
    found = versions.latest(spark, path)
    assert (found.rows.first().v, found.meta, found.number, found.skipped) == (2, {"v": 2}, 2, 0)
    with open(f"{path}/manifest/torn.json", "w") as f:
        f.write('{"number": 9, "folder": "version-x", "me\n{"number": 8, "folder": "gone", "meta": "{\\"v\\": 8}"}\n{"number": 7, "folder": "y", "meta": "{"}\n')
    found = versions.latest(spark, path)
    assert (found.rows.first().v, found.skipped) == (2, 2)
    assert versions.publish(rows(4), path, {"v": 4}) == 10 or versions.latest(spark, path).rows.first().v == 4


def test_history_passes_over_broken_records(spark, tmp_path):
    path = str(tmp_path / "history")
    assert versions.history(spark, path, "run") == ([], 0)
    for k in range(3):
        versions.append(spark, path, "run", {"epoch": k})
    versions.append(spark, path, "other", {"epoch": 9})
    with open(f"{path}/torn.json", "w") as f:
        f.write('{"at": 5, "run_id": "run", "rec\n' + json.dumps({"at": 6, "run_id": "run", "record": "{\"epoch\": "}) + "\n")
    assert versions.history(spark, path, "run") == ([{"epoch": k} for k in range(3)], 2)


class Killed(Exception):
    pass


def killed_at(monkeypatch, module, name, call):
    """Let the pass of that number fail as if the driver had died in it."""
    real, calls = getattr(module, name), []

    def run(*args, **more):
        calls.append(1)
        if len(calls) == call:
            raise Killed
        return real(*args, **more)

    monkeypatch.setattr(module, name, run)
    return calls


def test_fits_resume(spark, tmp_path, monkeypatch):
    df = frame(spark, data(200)[8:])
    whole, mixture = CosineKMeans(4, tol=0.0, max_iter=7).fit(df), VMFMixture(3, tol=0.0, max_iter=7).fit(df)
    sweep, scores = elbow_ckmeans(df, 4, tol=0.0, max_iter=5), elbow_vmf(df, 4, tol=0.0, max_iter=5)
    runs = [
        (K, "lloyd_pass", lambda: CosineKMeans(4, tol=0.0, max_iter=7).fit(df, resume=str(tmp_path / "a"), every=1), lambda m: (m.centroids.tobytes(), m.inertia_, m.n_iter_), whole, 7),
        (vmf, "em_pass", lambda: VMFMixture(3, tol=0.0, max_iter=7).fit(df, resume=str(tmp_path / "b"), every=1), lambda m: (*(p.tobytes() for p in m.parameters), m.lower_bound_, m.n_iter_), mixture, 7),
        (K, "lloyd_pass", lambda: elbow_ckmeans(df, 4, tol=0.0, max_iter=5, resume=str(tmp_path / "c")), lambda s: s, sweep, 5),
        (vmf, "em_pass", lambda: elbow_vmf(df, 4, tol=0.0, max_iter=5, resume=str(tmp_path / "d")), lambda s: s, scores, 5),
    ]
    for module, name, fit, state, want, passes in runs:
        with monkeypatch.context() as m:
            killed_at(m, module, name, 4)
            with pytest.raises(Killed):
                fit()
        with monkeypatch.context() as m:
            calls = killed_at(m, module, name, 99)
            assert state(fit()) == state(want)
            assert len(calls) <= passes + 1
        if passes == 7:  # whole: nothing is left to do
            with monkeypatch.context() as m:
                calls = killed_at(m, module, name, 99)
                assert state(fit()) == state(want) and not calls
    with pytest.raises(ValueError, match="holds a fit of"):
        CosineKMeans(4, tol=0.1).fit(df, resume=str(tmp_path / "a"))


def test_saved_models_come_back_whole(spark, tmp_path):
    df = frame(spark, data(60)[8:])
    mixture = VMFMixture(2, random_state=3, tol=1e-3, max_iter=9, init="random", kappa_init=4.0, kappa_min=1e-3, start_rows=20).fit(df)
    mixture.save(spark, str(tmp_path / "m"))
    back = VMFMixture.load(spark, str(tmp_path / "m"))
    assert back._asked() == mixture._asked() and all(np.array_equal(a, b) for a, b in zip(back.parameters, mixture.parameters))
    assert (back.lower_bound_, back.n_iter_) == (mixture.lower_bound_, mixture.n_iter_)
    with pytest.raises(KeyError):
        VMFMixture.load(spark, str(tmp_path / "none"))
    with pytest.raises(KeyError):
        CosineKMeans(2).load_centroids(spark, str(tmp_path / "m"))


def test_bounded_start(spark):
    x = data(300)[8:]
    df, n = frame(spark, x, parts=5), len(x)
    digest = F.md5(F.concat_ws(":", F.lit("42"), F.col("row_id").cast("string"), F.lit("subset")))
    for m in (1, 7, 60, n, n + 5):
        want = {r.row_id for r in df.orderBy(digest, "row_id").limit(m).collect()}
        assert {r.row_id for r in bottom_rows(df, n, m, 42).collect()} == want
    assert np.allclose(VMFMixture(5).drawn(df, n)[1] / np.linalg.norm(VMFMixture(5).drawn(df, n)[1], axis=1, keepdims=True), seed_centroids(df, 5, 42, 1e-8))
    ids, _ = VMFMixture(4, start_rows=30).drawn(df, n)
    assert set(ids) <= {r.row_id for r in bottom_rows(df, n, 30, 42).collect()} and len(set(ids)) == 4
    drawn = VMFMixture(50, init="random", start_rows=60).drawn(df, n)[0]
    assert len(set(drawn)) < 50  # with replacement
    assert start_rows([9, 4], np.eye(2), 3, 1, "random") == start_rows([9, 4], np.eye(2), 3, 1, "random")
    with pytest.raises(ValueError):
        VMFMixture(5, start_rows=4)


def test_faint_components_keep_their_own_scale(spark):
    x = data(400, 8, 3)
    u, seeds = M.unit(x, 1e-12), M.unit(x[[0, 1, 2]])
    p = seeds, np.array([6.0, 9.0, 300.0]), np.log(np.array([1.0 - 1e-12, 1e-12, 1e-90]))
    z = vmf.log_joint(u, p)
    g = np.exp(z - vmf._logsumexp(z)[:, None])
    n, s = g.sum(0), g.T @ u
    length = np.sqrt((s * s).sum(1))
    r = np.clip(length / n, 1e-6, 1.0 - 1e-6)
    assert n[1] < 1e-8 and n[2] < 1e-30
    found = [vmf.em_pass(frame(spark, x, parts=parts), {0: p})[0][0] for parts in (2, 5)]
    mus, kappas, logpi = found[0]
    assert np.allclose(mus, s / length[:, None], atol=1e-9)
    assert np.allclose(kappas, r * (8 - r * r) / (1.0 - r * r + 1e-8), rtol=1e-8)
    assert np.allclose(logpi, np.log(n / n.sum()), atol=1e-9)
    assert all((a == b).all() for a, b in zip(*found))
    nothing = vmf.em_pass(frame(spark, x), {0: (p[0], p[1], np.array([0.0, -1.0, -1e4]))})[0][0]
    assert all(np.isfinite(v).all() for v in nothing) and not nothing[0][2].any()
