"""Mixtures of von Mises-Fisher distributions with distributed EM."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.functions import rng
from spectroloom.operators import exact
from spectroloom.operators.kmeans import EVERY, STATS, Progress, stat_rows, summed
from spectroloom.operators.matrix import check_broadcast, lists, matrix, spread, unit, usable_matrix, validate, vectors
from spectroloom.operators.selection import find_elbow_curvature
from spectroloom.sources import versions

#: Concentrations below the first use the small series, above the second the asymptotic one; between, both.
SMALL, LARGE = 2.0, 12.0


def _mixed(kappa: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
    w = np.clip((kappa - SMALL) / (LARGE - SMALL), 0.0, 1.0)
    return np.where(kappa <= SMALL, small, np.where(kappa >= LARGE, large, (1.0 - w) * small + w * large))


def log_bessel(nu: float, kappa: np.ndarray) -> np.ndarray:
    """An approximation of log I_nu: three series terms for small arguments, two corrections for large ones.

    Kept as it is, not exact: likelihoods and criteria depend on it.
    """
    k = np.asarray(kappa, float)
    k2, m = k * k, 4.0 * nu * nu
    series = 1.0 + k2 / (4.0 * (nu + 1.0)) + k2 * k2 / (32.0 * (nu + 1.0) * (nu + 2.0))
    small = nu * np.log(np.maximum(0.5 * k, 1e-12)) - math.lgamma(nu + 1.0) + np.log(np.maximum(series, 1e-12))
    safe = np.maximum(k, 1e-6)
    corrections = 1.0 - (m - 1.0) / (8.0 * safe) + (m - 1.0) * (m - 9.0) / (128.0 * safe * safe)
    large = k - 0.5 * np.log(2.0 * math.pi * safe) + np.log(np.maximum(corrections, 1e-12))
    return _mixed(k, small, large)


def vmf_bessel_ratio(nu: float, kappa: np.ndarray) -> np.ndarray:
    """An approximation of I_(nu+1) / I_nu, within (0, 1)."""
    k = np.asarray(kappa, float)
    safe, a = np.maximum(k, 1e-6), 2.0 * nu + 2.0
    small = safe / a * (1.0 - safe * safe / (2.0 * a * (a + 2.0)))
    large = 1.0 - (a - 1.0) / (2.0 * safe) + (4.0 * nu * nu - 1.0) / (8.0 * safe * safe)
    return np.clip(_mixed(k, small, large), 1e-6, 1.0 - 1e-6)


def vmf_logC(d: int, kappa: np.ndarray) -> np.ndarray:
    """Log of the density's normaliser in d dimensions."""
    nu = 0.5 * d - 1.0
    return nu * np.log(np.maximum(kappa, 1e-12)) - (nu + 1.0) * math.log(2.0 * math.pi) - log_bessel(nu, kappa)


Parameters = tuple[np.ndarray, np.ndarray, np.ndarray]  # means, concentrations, log weights


def log_joint(u: np.ndarray, p: Parameters) -> np.ndarray:
    mus, kappas, logpi = p
    top = logpi.max()
    weights = logpi - top - np.log(np.exp(logpi - top).sum())
    return exact.dots(u, mus) * kappas + vmf_logC(mus.shape[1], kappas) + weights


def _logsumexp(z: np.ndarray) -> np.ndarray:
    top = z.max(1, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]


#: Log likelihoods of rows are summed as four limbs, up to 2**32 in size.
LL_LIMBS, LL_WHOLE = 4, 32
#: The weight of a component without rows.
LEAST = 1e-300


#: Limbs hold 42 bits of a posterior below 1. A component whose posteriors are all below 2**-FAINT has its sums
#: taken again, of its posteriors times a power of two. The other number stands for no posterior at all.
FAINT, NOTHING = 8, -5000


def em_pass(rows: DataFrame, models: dict[int, Parameters], kappa_min: float = 1e-6) -> dict[int, tuple[Parameters, float]]:
    """One EM step of each model, in one job: new parameters, and the log likelihood under the old ones.

    Tasks send one row for each component. Posteriors are each row's own and their sums exact, so results are
    the same bits on any partitioning. A second job sums up the components that have nearly vanished, at their
    own scale, as they may come back.
    """
    found, logs = _sums(rows, models, {m: np.zeros(len(p[0]), int) for m, p in models.items()})
    scales = {m: top for m, (_, _, top) in found.items()}
    if faint := {m: np.where((top < -FAINT) & (top > NOTHING), top, NOTHING) for m, top in scales.items() if ((top < -FAINT) & (top > NOTHING)).any()}:
        again, _ = _sums(rows, {m: models[m] for m in faint}, faint)
        for m, (s, n, _) in again.items():
            use = faint[m] > NOTHING
            found[m][0][use], found[m][1][use] = s[use], n[use]
    return {m: (_m_step(s, n, np.where(top < -FAINT, top, 0), kappa_min), logs[m]) for m, (s, n, top) in found.items()}


def _sums(rows: DataFrame, models: dict[int, Parameters], scales: dict[int, np.ndarray]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], dict[int, float]]:
    """Sums of each component's posteriors times rows and of its posteriors, over 2**scale, and the exponent of its largest posterior; and each model's log likelihood.

    A component whose scale is NOTHING is left out.
    """
    d = next(iter(models.values()))[0].shape[1]
    check_broadcast(sum(len(p[0]) for p in models.values()), d)
    shared = rows.sparkSession.sparkContext.broadcast((models, scales))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        tops: dict[int, np.ndarray] = {}
        for batch in batches:
            u = unit(matrix(batch.column(1)), 1e-12)
            for m, p in shared.value[0].items():
                if len(u):
                    z, scale = log_joint(u, p), shared.value[1][m]
                    ll = _logsumexp(z)
                    g = np.minimum(np.exp(z - ll[:, None]), 1.0)
                    most = g.max(0)
                    tops[m] = np.maximum(tops.get(m, NOTHING), np.where(most > 0.0, np.frexp(most)[1], NOTHING))
                    g = np.where(scale > NOTHING, np.ldexp(g, np.where(scale > NOTHING, -scale, 0)), 0.0)
                    old = held.setdefault(m, [0.0, 0.0, 0.0, 0.0])
                    for i, found in enumerate((exact.weighted(g, u), exact.limbs(g).sum(1), exact.limbs(ll, LL_LIMBS, LL_WHOLE).sum(1), float(len(u)))):
                        old[i] = old[i] + found
        if held:
            yield stat_rows({(m, k): np.concatenate([s[:, k].ravel(), n[:, k], ll * (k == 0), [count, tops[m][k]]]) for m, (s, n, ll, count) in held.items() for k in range(s.shape[1]) if shared.value[1][m][k] > NOTHING})

    out = {m: (np.zeros_like(p[0]), np.zeros(len(p[0])), np.full(len(p[0]), NOTHING)) for m, p in models.items()}
    ll = dict.fromkeys(models, 0.0)
    size = 4 * d + exact.LIMBS + LL_LIMBS
    for (m, k), found in summed(rows.select("row_id", "x").mapInArrow(stats, STATS), size + 1).items():
        if found[size] > exact.MOST_ROWS:
            raise OverflowError(f"{found[size]:.0f} rows, exact sums hold {exact.MOST_ROWS}")
        sums, weights, logs = np.split(found[:size], (4 * d, 4 * d + exact.LIMBS))
        s, n, top = out[m]
        s[k], n[k], top[k] = exact.weighted_value(sums.reshape(4, d)), exact.value(weights[:, None])[0], found[-1]
        if k == 0:
            ll[m] = float(exact.value(logs[:, None], LL_WHOLE)[0])
    return out, ll


def total_loglik(scored: DataFrame) -> tuple[float, int]:
    """The exact sum of the column ``loglik`` and how many rows have one."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(LL_LIMBS + 1)
        for batch in batches:
            held = np.asarray(batch.column(0).drop_null())
            sums += np.r_[exact.limbs(held, LL_LIMBS, LL_WHOLE).sum(1), len(held)]
        yield stat_rows({(0, 0): sums})

    found = summed(scored.select("loglik").mapInArrow(stats, STATS)).get((0, 0), np.zeros(LL_LIMBS + 1))
    return float(exact.value(found[:-1, None], LL_WHOLE)[0]), int(found[-1])


def _m_step(s: np.ndarray, n: np.ndarray, scale: np.ndarray, kappa_min: float) -> Parameters:
    """Parameters of sums over 2**scale. Only a component without any weight has a least one; a small one keeps its own."""
    length = np.sqrt((s * s).sum(1))
    weight, length = np.maximum(np.ldexp(n, scale), LEAST), np.maximum(length, LEAST)
    r, d = np.clip(length / np.maximum(n, LEAST), 1e-6, 1.0 - 1e-6), s.shape[1]
    kappas = np.maximum(r * (d - r * r) / (1.0 - r * r + 1e-8), kappa_min)
    return unit(s / length[:, None], 1e-12), kappas, np.log(np.maximum(weight / weight.sum(), LEAST))


def fit_models(rows: DataFrame, starts: dict[int, Parameters], tol: float, max_iter: int, kappa_min: float = 1e-6, progress: Progress | None = None) -> dict[int, tuple[Parameters, float, int]]:
    """Parameters, log likelihood (of those before the last step) and steps of each model, in lock step.

    With ``progress``, the state is written every few steps and at the end, and taken up again from there.
    """
    models, notes, first = dict(starts), {m: {} for m in starts}, 1
    if progress and (held := progress.load()):
        models, notes, first = _from_arrays(held[1]), held[2], held[0] + 1
    for step in range(first, max_iter + 1):
        live = {m: p for m, p in models.items() if "done" not in notes[m]}
        if not live:
            break
        for m, (p, ll) in em_pass(rows, live, kappa_min).items():
            before = notes[m].get("loglik")
            gap = np.inf if before is None else abs(ll - before)
            if gap < 1e-6 or gap / (abs(1.0 if before is None else before) + 1e-12) < tol or step == max_iter:
                notes[m]["done"] = step
            models[m], notes[m]["loglik"] = p, ll
        if progress and (step % progress.every == 0 or all("done" in v for v in notes.values())):
            progress.save(step, {m: list(p) for m, p in models.items()}, notes)
    return {m: (models[m], notes[m]["loglik"], notes[m]["done"]) for m in models}


def _from_arrays(held: dict[int, list[np.ndarray]]) -> dict[int, Parameters]:
    return {m: (mus, kappas[:, 0], logpi[:, 0]) for m, (mus, kappas, logpi) in held.items()}


#: Rows that a start is drawn from: these or 50 for each component, whichever is more.
START_ROWS, START_ROWS_EACH = 10_000, 50


def bottom_rows(rows: DataFrame, n: int, m: int, seed: int) -> DataFrame:
    """The ``m`` of ``n`` rows with the least digests of (seed, row), all rows if there are no more.

    Digests are uniform, so a threshold a little above m / n leaves hardly more than m rows, each task's own, to
    be ordered; it is raised in the unlikely case that it leaves fewer.
    """
    if n <= m:
        return rows
    drawn = rows.withColumn("_digest", rng.digest(seed, F.col("row_id"), "subset"))
    limit = (m + 6.0 * math.sqrt(m) + 50.0) / n
    while limit < 1.0:
        few = drawn.where(rng.uniform(F.col("_digest")) < limit)
        if few.count() >= m:
            drawn = few
            break
        limit *= 2.0
    return drawn.orderBy("_digest", "row_id").limit(m).drop("_digest")


def _uniform(seed: int, *slots: object) -> float:
    """The driver's version of ``rng.uniform`` of a digest."""
    return int(hashlib.md5(":".join(map(str, (seed, *slots))).encode()).hexdigest()[:8], 16) / 4294967296.0


def start_rows(ids: list[int], x: np.ndarray, k: int, seed: int, init: str = "kmeans++", least: float = 1e-8) -> list[int]:
    """Which of a bounded sample's rows start the ``k`` components.

    ``kmeans++`` runs the race of ``seed_centroids`` over the sample; ``random`` draws with replacement, row
    floor(u m) of the sample in the order of ids for each u.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    if init == "random":
        return [order[int(_uniform(seed, "random", j) * len(ids))] for j in range(k)]
    u, weight, out = unit(x), np.ones(len(ids)), []
    for step in range(k):
        time = [(-math.log(1.0 - _uniform(seed, ids[i], f"seed{step}")) / weight[i], ids[i], i) for i in order]
        out.append(min(time)[2])
        weight = np.maximum(1.0 - exact.dots(u, u[out]).max(1), least)
    return out


class VMFMixture:
    """A von Mises-Fisher mixture; seeds and steps do not depend on the partitioning."""

    def __init__(self, n_components: int, d: int | None = None, random_state: int = 42, tol: float = 1e-4, max_iter: int = 200, init: str = "kmeans++", kappa_init: float = 10.0, kappa_min: float = 1e-6, start_rows: int | None = None) -> None:
        if n_components <= 0 or max_iter <= 0:
            raise ValueError("n_components and max_iter must be positive")
        if init not in ("kmeans++", "random"):
            raise ValueError("init must be kmeans++ or random")
        if kappa_init <= 0:
            raise ValueError("kappa_init must be positive")
        if start_rows is not None and start_rows < n_components:
            raise ValueError("start_rows must be as many as the components at least")
        self.K, self.d, self.random_state, self.tol, self.max_iter = n_components, d, random_state, tol, max_iter
        self.init, self.kappa_init, self.kappa_min = init, kappa_init, kappa_min
        self.start_rows = start_rows if start_rows is not None else max(START_ROWS, START_ROWS_EACH * n_components)
        self.parameters: Parameters | None = None
        self.lower_bound_: float | None = None
        self.n_iter_ = 0

    def _asked(self) -> dict:
        return {"K": self.K, "d": self.d, "random_state": self.random_state, "tol": self.tol, "max_iter": self.max_iter, "init": self.init, "kappa_init": self.kappa_init, "kappa_min": self.kappa_min, "start_rows": self.start_rows}

    def drawn(self, rows: DataFrame, n: int) -> tuple[list[int], np.ndarray]:
        """``(row ids, vectors)`` of the rows that the components start at: from a sample of ``start_rows`` rows, in one job."""
        held = bottom_rows(rows, n, self.start_rows, self.random_state).toArrow()
        ids, x = held.column("row_id").to_pylist(), matrix(held.column("x").combine_chunks())
        first = start_rows(ids, x, self.K, self.random_state, self.init)
        return [ids[i] for i in first], x[first]

    def start(self, rows: DataFrame, mus: np.ndarray | None = None, n: int | None = None) -> Parameters:
        if mus is None:
            mus = self.drawn(rows, rows.count() if n is None else n)[1]
        return unit(np.asarray(mus, float), 1e-12), np.full(self.K, float(self.kappa_init)), np.full(self.K, -math.log(self.K))

    def fit(self, df: DataFrame, row_id: str = "row_id", x: str = "x", mus: np.ndarray | None = None, resume: str | None = None, every: int = EVERY) -> VMFMixture:
        """Start (at ``mus`` or at drawn rows) and iterate; with ``resume``, keep the state below that path and go on from what is there."""
        rows = vectors(df, row_id, x).persist()
        d = validate(rows)
        if self.d not in (None, d):
            raise ValueError(f"rows have {d} values, the model {self.d}")
        self.d = d
        progress = Progress(df.sparkSession, resume, {"fit": "vmf", **self._asked()}, every) if resume else None
        if progress and (held := progress.load()):
            start = _from_arrays(held[1])[0]
        else:
            start = self.start(rows, mus)
            if progress:
                progress.save(0, {0: list(start)}, {0: {}})
        self.parameters, self.lower_bound_, self.n_iter_ = fit_models(rows, {0: start}, self.tol, self.max_iter, self.kappa_min, progress)[0]
        rows.unpersist()
        return self

    def _fitted(self) -> Parameters:
        if self.parameters is None:
            raise RuntimeError("fit first")
        return self.parameters

    def predict_proba(self, df: DataFrame, row_id: str = "row_id", x: str = "x") -> DataFrame:
        """``(row_id, label, gamma, loglik)``: the likeliest component, all posteriors, and the row's log likelihood.

        All three are null for a row that is null or holds a null or non-finite value; a row of another length
        than the model's is an error.
        """
        p = df.sparkSession.sparkContext.broadcast(self._fitted())

        def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, m = usable_matrix(batch.column(1), p.value[0].shape[1])
                z = log_joint(unit(m, 1e-12), p.value)
                ll = _logsumexp(z)
                found = pa.array(z.argmax(1).astype(np.int32)), lists(np.exp(z - ll[:, None])), pa.array(ll)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(spread(good, f) for f in found)], names=["row_id", "label", "gamma", "loglik"])

        return vectors(df, row_id, x).mapInArrow(posterior, "row_id long, label int, gamma array<double>, loglik double")

    def predict(self, df: DataFrame, row_id: str = "row_id", x: str = "x") -> DataFrame:
        return self.predict_proba(df, row_id, x).select("row_id", "label")

    def loglik(self, df: DataFrame, row_id: str = "row_id", x: str = "x", average: bool = False) -> float:
        """Of the rows that have one; exact, whatever the partitioning."""
        ll, n = total_loglik(self.predict_proba(df, row_id, x))
        return ll / n if average and n else ll

    def num_params(self) -> int:
        return self.K * self.d + self.K - 1

    def bic(self, df: DataFrame, row_id: str = "row_id", x: str = "x") -> float:
        ll, n = total_loglik(self.predict_proba(df, row_id, x))
        return -2.0 * ll + self.num_params() * math.log(n)

    def state_dict(self) -> dict:
        mus, kappas, logpi = self._fitted()
        return {"mus": mus, "kappas": kappas, "logpi": logpi, "logC": vmf_logC(self.d, kappas), "lower_bound": self.lower_bound_, "n_iter": self.n_iter_, **self._asked()}

    def save(self, spark: SparkSession, path: str) -> None:
        """Publish the model as a new version below ``path``; readers see the one before until it is whole."""
        s = self.state_dict()
        columns = {"k": pa.array(np.arange(self.K, dtype=np.int32)), "mu": lists(s["mus"]), **{c: pa.array(s[c]) for c in ("kappas", "logpi", "logC")}}
        rows = spark.createDataFrame(pa.table(columns)).withColumnRenamed("kappas", "kappa")
        versions.publish(rows.coalesce(1), path, {"model": "vmf", "lower_bound": self.lower_bound_, "n_iter": self.n_iter_, **self._asked()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VMFMixture:
        """The newest whole version below ``path``, with all its parameters."""
        found = versions.latest(spark, path)
        if found is None or found.meta.get("model") != "vmf":
            raise KeyError("not a saved mixture")
        asked = {k: found.meta[k] for k in ("d", "random_state", "tol", "max_iter", "init", "kappa_init", "kappa_min", "start_rows")}
        out, rows = cls(found.meta["K"], **asked), found.rows.orderBy("k").toArrow()
        out.parameters = matrix(rows.column("mu").combine_chunks()), np.asarray(rows.column("kappa")), np.asarray(rows.column("logpi"))
        out.lower_bound_, out.n_iter_ = found.meta["lower_bound"], found.meta["n_iter"]
        return out


def elbow_vmf(df: DataFrame, k_max: int = 50, row_id: str = "row_id", x: str = "x", random_state: int = 42, criterion: str = "bic", tol: float = 1e-4, max_iter: int = 200, mus: np.ndarray | None = None, resume: str | None = None) -> tuple[list[int], list[float], int, int, float, int]:
    """K = 1..k_max: K values, scores (BIC or mean negative log likelihood), elbow K, index and curvature, best K.

    The elbow is sought on the negated scores, whose running minimum is flat while the score falls; the
    K of the least score comes last. ``resume`` is a path for the sweep's state, as in ``fit``.
    """
    if criterion not in ("bic", "nll"):
        raise ValueError("criterion must be bic or nll")
    rows = vectors(df, row_id, x).persist()
    d, n = validate(rows), rows.count()
    seeds = mus if mus is not None else VMFMixture(k_max, random_state=random_state).drawn(rows, n)[1]
    starts = {k: VMFMixture(k).start(rows, seeds[:k]) for k in range(1, k_max + 1)}
    progress = Progress(df.sparkSession, resume, {"fit": "vmf sweep", "k_max": k_max, "tol": tol, "max_iter": max_iter, "random_state": random_state}) if resume else None
    fitted = fit_models(rows, starts, tol, max_iter, progress=progress)
    final = em_pass(rows, {k: p for k, (p, _, _) in fitted.items()})  # the likelihoods under the fitted parameters
    rows.unpersist()
    ks = list(range(1, k_max + 1))
    scores = [-2.0 * final[k][1] + (k * d + k - 1) * math.log(n) if criterion == "bic" else -final[k][1] / n for k in ks]
    return ks, scores, *find_elbow_curvature(ks, [-s for s in scores]), ks[int(np.argmin(scores))]
