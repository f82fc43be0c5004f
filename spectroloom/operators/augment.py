"""Augmentation on the sphere of centred rows: fractional shifts and rotations towards random directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.functions import rng
from spectroloom.functions import vectors as V


@dataclass(frozen=True)
class SpectraAugmenterConfig:
    shift_prob: float = 0.5
    shift_delta_range: tuple[float, float] = (-2.0, 2.0)
    noise_prob: float = 0.5
    noise_angle_deg_range: tuple[float, float] = (0.5, 3.0)
    shuffle_order_per_batch: bool = True
    recenter_after_each_op: bool = True
    renorm_to_input_norm: bool = True
    eps: float = 1e-8

    def __post_init__(self) -> None:
        for name in ("shift_prob", "noise_prob"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("shift_delta_range", "noise_angle_deg_range"):
            low, high = getattr(self, name)
            if low > high:
                raise ValueError(f"{name} must be ordered")
        if self.noise_angle_deg_range[0] < 0.0 or self.noise_angle_deg_range[1] > 180.0:
            raise ValueError("angles must lie in [0, 180]")
        if self.eps <= 0.0:
            raise ValueError("eps must be positive")


class SpectraAugmenter:
    """Draws are functions of the seed and the row, so a row is augmented alike wherever it is."""

    def __init__(self, config: SpectraAugmenterConfig | None = None, seed: int = 42) -> None:
        self.config, self.seed = config or SpectraAugmenterConfig(), seed

    def _uniform(self, row: Column, slot: str, low: float, high: float) -> Column:
        return F.lit(low) + rng.uniform(rng.digest(self.seed, row, slot)) * F.lit(high - low)

    def _back(self, x: Column, reference: Column) -> Column:
        c = self.config
        return V.reproject(x, reference, c.recenter_after_each_op, c.renorm_to_input_norm, c.eps)

    def shift(self, x: Column, row: Column) -> Column:
        delta = self._uniform(row, "delta", *self.config.shift_delta_range)
        moved = V.let(V.fractional_shift(x, delta), lambda s: self._back(s, x))
        return F.when(rng.uniform(rng.digest(self.seed, row, "shift")) < self.config.shift_prob, moved).otherwise(x)

    def _gate(self, row: Column) -> Column:
        return rng.uniform(rng.digest(self.seed, row, "noise")) < self.config.noise_prob

    def _direction(self, x: Column, row: Column) -> Column:
        return rng.normal_vector(f"{self.seed}:noise", row, F.size(x))

    def noise(self, x: Column, row: Column, kept: Column | None = None) -> Column:
        """Rows of the gate turned and brought back to their sphere; those of a ``kept`` batch as they are."""
        low, high = self.config.noise_angle_deg_range
        angle = F.radians(self._uniform(row, "angle", low, high))
        turned = V.let(V.rotate_along(x, self._direction(x, row), angle, self.config.eps), lambda r: self._back(r, x))
        applies = self._gate(row) if kept is None else self._gate(row) & ~kept
        return F.when(applies, turned).otherwise(x)

    def _kept_batches(self, rows: DataFrame, batch: str, row: Column) -> DataFrame:
        """Batches in which some row is to be turned and none can be: none has a tangent longer than ``eps``.

        One partial aggregate; what leaves a task is a flag for each batch.
        """
        can = V.norm(V.tangent(F.col("_noised"), self._direction(F.col("_noised"), row), self.config.eps)) > self.config.eps
        flags = rows.where(self._gate(row)).groupBy(F.col(batch).alias("_kept_batch")).agg(F.max(can).alias("_can"))
        return flags.where("not _can").select("_kept_batch", F.lit(True).alias("_kept"))

    def transform(self, df: DataFrame, row_id: str = "row_id", x: str = "x", output: str = "x", batch: str | None = None, training: bool = True) -> DataFrame:
        """Both operations, for every row; the rows as they are unless ``training``.

        The order is shift, noise, or with ``shuffle_order_per_batch`` drawn for each value of ``batch``
        (for the whole run if there is none). With ``batch``, a null of which is a batch too, noise decides for
        whole batches: where no row that it applies to has a tangent to turn along, all stay as they are; where
        some has, the others are still centred and scaled. Without, that is each row's own matter. A row without
        a value in ``x`` stays null.
        """
        if not isinstance(df.schema[x].dataType.elementType.typeName(), str) or df.schema[x].dataType.elementType.typeName() not in ("float", "double"):
            raise TypeError("rows must be floating-point arrays")
        if not training:
            return df.withColumn(output, F.col(x))
        row = F.col(row_id)
        out = df.withColumn("_x", V.vector(x)).withColumn("_x", F.when(F.size("_x") < 2, F.raise_error(F.lit("rows need at least 2 values"))).otherwise(F.col("_x")))
        first = F.lit(True)
        if self.config.shuffle_order_per_batch:
            first = rng.uniform(rng.digest(self.seed, F.col(batch) if batch else F.lit("run"), "order")) < 0.5
        if batch is None:
            shift_first = V.let(self.shift(F.col("_x"), row), lambda s: self.noise(s, row))
            noise_first = V.let(self.noise(F.col("_x"), row), lambda s: self.shift(s, row))
            return out.withColumn(output, F.when(first, shift_first).otherwise(noise_first)).drop("_x")
        out = out.withColumn("_noised", F.when(first, self.shift(F.col("_x"), row)).otherwise(F.col("_x")))
        out = out.join(self._kept_batches(out, batch, row), F.col(batch).eqNullSafe(F.col("_kept_batch")), "left")
        noised = V.let(self.noise(F.col("_noised"), row, F.col("_kept").isNotNull()), lambda n: F.when(first, n).otherwise(self.shift(n, row)))
        return out.withColumn(output, noised).drop("_x", "_noised", "_kept_batch", "_kept")
