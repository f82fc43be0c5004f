"""Saved models as SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from spectroloom.operators import exact
from spectroloom.operators.kmeans import CosineKMeans
from spectroloom.operators.matrix import check_broadcast, lists, spread, unit, usable_matrix
from spectroloom.operators.vmf import VMFMixture, log_joint
from spectroloom.sources import versions


def _by_batch(score: Callable[[np.ndarray], pa.Array], width: int) -> Callable:
    """A function of Arrow columns: what ``score`` gives for usable rows, null for others."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in columns:
            good, rows = usable_matrix(x.cast(pa.list_(pa.float64())), width)
            yield spread(good, score(rows))

    return run


def register_model(spark: SparkSession, name: str, path: str) -> str:
    """Make the newest model below ``path`` callable in SQL and say of which kind it is.

    ``name(x)`` is a row's label; a mixture also has ``name_gamma(x)``, its posteriors, and ``name_loglik(x)``. ``x``
    is any array of numbers; results are those of ``predict``: null for a row that is null or not finite, an
    error for one of another length. The model is sent to the tasks once, so it has to fit one.
    """
    found = versions.latest(spark, path)
    kind = found.meta.get("model") if found else None
    if kind == "kmeans":
        c = CosineKMeans(found.meta["n_components"]).load_centroids(spark, path).centroids
        check_broadcast(*c.shape)
        functions = {name: ("int", lambda x: pa.array(exact.dots(unit(x), c).argmax(1).astype(np.int32)))}
        width = c.shape[1]
    elif kind == "vmf":
        p = VMFMixture.load(spark, path).parameters
        check_broadcast(*p[0].shape)
        width = p[0].shape[1]

        def posterior(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = log_joint(unit(x, 1e-12), p)
            top = z.max(1, keepdims=True)
            return z, (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]

        functions = {
            name: ("int", lambda x: pa.array(posterior(x)[0].argmax(1).astype(np.int32))),
            f"{name}_gamma": ("array<double>", lambda x: lists(np.exp(posterior(x)[0] - posterior(x)[1][:, None]))),
            f"{name}_loglik": ("double", lambda x: pa.array(posterior(x)[1])),
        }
    else:
        raise KeyError(f"no saved model below {path}")
    for called, (kind_of, score) in functions.items():
        run = _by_batch(score, width)
        run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
        spark.udf.register(called, arrow_udf(run, kind_of))
    return kind
