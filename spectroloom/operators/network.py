"""Inference with a masked autoencoder of spectra: patches, a pre-norm transformer encoder, an MLP decoder.

Weights are a small dictionary of arrays that every task gets; rows stream through Arrow batches, of which few
enough go through the network at a time that a layer's values are bounded.
Hidden patches are left out as attention keys, so they cannot reach the latent vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.operators.matrix import lists, matrix

_erf = np.frompyfunc(math.erf, 1, 1)

#: Values of the widest layer that a task computes at once.
AT_ONCE = 1 << 19


@dataclass(frozen=True)
class AutoencoderConfig:
    seq_len: int = 256
    n_patches: int = 16
    d_model: int = 256
    nhead: int = 4
    num_layers: int = 4
    dim_feedforward: int | None = None
    latent_dim: int = 16
    latent_normalize: bool = True
    decoder_num_layers: int = 2
    decoder_hidden: int | None = None
    n_mask: int = 4

    def __post_init__(self) -> None:
        if self.seq_len % self.n_patches:
            raise ValueError("seq_len must be a multiple of n_patches")
        if self.d_model % self.nhead:
            raise ValueError("d_model must be a multiple of nhead")
        if not 0 <= self.n_mask <= self.n_patches:
            raise ValueError("n_mask must lie in [0, n_patches]")


def shapes(c: AutoencoderConfig) -> dict[str, tuple[int, ...]]:
    """The weights' names and shapes."""
    d, f = c.d_model, c.dim_feedforward or 4 * c.d_model
    out: dict[str, tuple[int, ...]] = {"patch.weight": (d, c.seq_len // c.n_patches), "patch.bias": (d,), "cls_token": (d,), "pos_embed": (1 + c.n_patches, d)}
    for k in range(c.num_layers):
        for name, shape in (("norm1", (d,)), ("norm2", (d,))):
            out |= {f"layer{k}.{name}.weight": shape, f"layer{k}.{name}.bias": shape}
        for name, shape in (("qkv", (3 * d, d)), ("out", (d, d)), ("up", (f, d)), ("down", (d, f))):
            out |= {f"layer{k}.{name}.weight": shape, f"layer{k}.{name}.bias": shape[:1]}
    out |= {"latent.weight": (c.latent_dim, d), "latent.bias": (c.latent_dim,)}
    sizes = [c.latent_dim, *[c.decoder_hidden or c.seq_len] * (c.decoder_num_layers - 1), c.seq_len]
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out |= {f"decoder{k}.weight": (b, a), f"decoder{k}.bias": (b,)}
    return out


def rows_at_once(c: AutoencoderConfig) -> int:
    """How many rows have AT_ONCE values in the widest layer; one at least."""
    tokens = c.n_patches + 1
    encoder = tokens * max(c.dim_feedforward or 4 * c.d_model, 3 * c.d_model, c.nhead * tokens)
    return max(1, AT_ONCE // max(encoder, c.seq_len, c.decoder_hidden or 0))


def slices(batch: pa.RecordBatch, c: AutoencoderConfig) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices that may go through the network at once; none of an empty batch."""
    size = rows_at_once(c)
    return (batch.slice(i, size) for i in range(0, batch.num_rows, size))


def initial_weights(c: AutoencoderConfig, seed: int = 42) -> dict[str, np.ndarray]:
    """Seeded weights: scaled uniform matrices, unit norms, small tokens."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(c).items():
        if name in ("cls_token", "pos_embed"):
            out[name] = np.clip(rng.normal(0.0, 0.02, shape), -2.0, 2.0)
        elif len(shape) == 2:
            out[name] = rng.uniform(-1.0, 1.0, shape) / math.sqrt(shape[1])
        else:
            out[name] = np.ones(shape) if "norm" in name and name.endswith("weight") else np.zeros(shape)
    return out


def save_weights(path: str, config: AutoencoderConfig, weights: dict[str, np.ndarray], spark: SparkSession) -> None:
    """Weights as a Parquet table ``(name, shape, values)`` and the configuration as its first row."""
    head = [("config", [], [], str(asdict(config)))]
    rows = [(k, list(v.shape), v.ravel().tolist(), "") for k, v in weights.items()]
    spark.createDataFrame(head + rows, "name string, shape array<int>, values array<double>, meta string").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(path: str, spark: SparkSession) -> tuple[AutoencoderConfig, dict[str, np.ndarray]]:
    import ast

    rows = spark.read.parquet(path).collect()
    config = next(AutoencoderConfig(**ast.literal_eval(r["meta"])) for r in rows if r["name"] == "config")
    return config, {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows if r["name"] != "config"}


def _linear(w: dict[str, np.ndarray], name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def _norm(w: dict[str, np.ndarray], name: str, x: np.ndarray) -> np.ndarray:
    c = x - x.mean(-1, keepdims=True)
    return c / np.sqrt((c * c).mean(-1, keepdims=True) + 1e-5) * w[f"{name}.weight"] + w[f"{name}.bias"]


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)).astype(float))


def encode_rows(c: AutoencoderConfig, w: dict[str, np.ndarray], x: np.ndarray, visible: np.ndarray) -> np.ndarray:
    """Latent vectors. A row without a visible patch sees its class token only."""
    n, p = len(x), c.n_patches
    if x.shape[1:] != (c.seq_len,) or visible.shape != x.shape:
        raise ValueError(f"rows and masks must have {c.seq_len} values")
    by_patch = visible.reshape(n, p, -1)
    if (by_patch.any(2) != by_patch.all(2)).any():
        raise ValueError("a patch must be all visible or all hidden")
    keys = np.concatenate([np.ones((n, 1), bool), by_patch.all(2)], 1)
    tokens = np.concatenate([np.broadcast_to(w["cls_token"], (n, 1, c.d_model)), _linear(w, "patch", x.reshape(n, p, -1))], 1) + w["pos_embed"]
    heads = lambda t: t.reshape(n, p + 1, c.nhead, -1).transpose(0, 2, 1, 3)
    for k in range(c.num_layers):
        q, key, value = map(heads, np.split(_linear(w, f"layer{k}.qkv", _norm(w, f"layer{k}.norm1", tokens)), 3, -1))
        scores = np.where(keys[:, None, None, :], q @ key.transpose(0, 1, 3, 2) / math.sqrt(q.shape[-1]), -np.inf)
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        mixed = (scores / scores.sum(-1, keepdims=True) @ value).transpose(0, 2, 1, 3).reshape(n, p + 1, -1)
        tokens = tokens + _linear(w, f"layer{k}.out", mixed)
        tokens = tokens + _linear(w, f"layer{k}.down", _gelu(_linear(w, f"layer{k}.up", _norm(w, f"layer{k}.norm2", tokens))))
    z = _linear(w, "latent", tokens[:, 0])
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12) if c.latent_normalize else z


def decode_rows(c: AutoencoderConfig, w: dict[str, np.ndarray], z: np.ndarray) -> np.ndarray:
    for k in range(c.decoder_num_layers):
        z = _linear(w, f"decoder{k}", z)
        z = _gelu(z) if k < c.decoder_num_layers - 1 else z
    return z


class MaskedAutoencoder:
    """Encoder and decoder applied to DataFrames."""

    def __init__(self, config: AutoencoderConfig, weights: dict[str, np.ndarray] | None = None, seed: int = 42) -> None:
        self.config, self.weights = config, weights if weights is not None else initial_weights(config, seed)
        for name, shape in shapes(config).items():
            if self.weights[name].shape != shape:
                raise ValueError(f"{name} has shape {self.weights[name].shape}, not {shape}")

    def encode(self, df: DataFrame, row_id: str = "row_id", x: str = "x", visible: str | None = None) -> DataFrame:
        """``(row_id, z)``; all patches are visible unless a mask column is named."""
        return self._apply(df, row_id, x, visible, False)

    def forward(self, df: DataFrame, row_id: str = "row_id", x: str = "x", visible: str | None = None) -> DataFrame:
        """``(row_id, x_recon, z)``."""
        return self._apply(df, row_id, x, visible, True)

    def reconstruct(self, df: DataFrame, row_id: str = "row_id", x: str = "x", visible: str | None = None) -> DataFrame:
        return self.forward(df, row_id, x, visible).select("row_id", "x_recon")

    def _apply(self, df: DataFrame, row_id: str, x: str, visible: str | None, decode: bool) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast((self.config, self.weights))
        mask = F.col(visible) if visible else F.transform(x, lambda _: F.lit(True))
        rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(x).cast("array<double>").alias("x"), mask.cast("array<double>").alias("visible"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, w = model.value
            for batch in (part for whole in batches for part in slices(whole, c)):
                z = encode_rows(c, w, matrix(batch.column(1)), matrix(batch.column(2)) > 0)
                columns = [batch.column(0), *([lists(decode_rows(c, w, z))] if decode else []), lists(z)]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", *["x_recon"] * decode, "z"])

        return rows.mapInArrow(run, "row_id long, " + "x_recon array<double>, " * decode + "z array<double>")
