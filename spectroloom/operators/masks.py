"""Patch masks and losses over masked positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.functions import rng


def patch_mask(row: Column, seq_len: int, n_patches: int, n_mask: int, seed: int = 42) -> Column:
    """``ARRAY<BOOLEAN>`` with exactly ``n_mask`` patches masked (true), drawn for each row on its own."""
    if n_patches < 1 or seq_len % n_patches:
        raise ValueError("seq_len must be a multiple of n_patches")
    if not 0 <= n_mask <= n_patches:
        raise ValueError("n_mask must lie in [0, n_patches]")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_patches - 1)), lambda p: F.struct(rng.digest(seed, row, p).alias("h"), p.alias("p"))))
    chosen = F.transform(F.slice(drawn, 1, n_mask), lambda s: s["p"])
    size = seq_len // n_patches
    per_patch = F.get(F.transform(F.array(chosen), lambda c: F.transform(F.sequence(F.lit(0), F.lit(n_patches - 1)), lambda p: F.array_contains(c, p))), F.lit(0))
    return F.flatten(F.transform(per_patch, lambda m: F.array_repeat(m, size)))


def visible_mask(row: Column, seq_len: int, n_patches: int, n_mask: int, seed: int = 42) -> Column:
    """The positions that are not masked."""
    return F.transform(patch_mask(row, seq_len, n_patches, n_mask, seed), lambda m: ~m)


def patch_aligned(mask: Column, n_patches: int) -> Column:
    """Whether every patch is all true or all false."""
    size = (F.size(mask) / n_patches).cast("int")
    patch = lambda p: F.slice(mask, p * size + 1, size)
    return F.forall(F.sequence(F.lit(0), F.lit(n_patches - 1)), lambda p: F.size(F.array_distinct(patch(p))) == 1)


def row_loss(recon: Column, x: Column, masked: Column) -> tuple[Column, Column]:
    """A row's squared error over masked positions, and how many there are."""
    square = F.zip_with(recon, x, lambda a, b: (a - b) * (a - b))
    error = F.aggregate(F.zip_with(square, masked, lambda s, m: F.when(m, s).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    return error, F.size(F.filter(masked, lambda m: m))


def masked_sse(df: DataFrame, recon: str = "x_recon", x: str = "x", masked: str = "masked", reduction: str = "batch_mean", by: list[str] | None = None) -> DataFrame:
    """One ``loss`` (for each group of ``by``): the ``sum``, the ``mean`` over masked positions, or the sum over rows (``batch_mean``).

    With nothing masked the loss is 0.
    """
    if reduction not in ("sum", "mean", "batch_mean"):
        raise ValueError(f"unknown reduction {reduction!r}")
    error, count = row_loss(F.col(recon), F.col(x), F.col(masked))
    total = F.coalesce(F.sum("_error"), F.lit(0.0))
    value = {"sum": total, "mean": total / F.greatest(F.coalesce(F.sum("_count"), F.lit(0)), F.lit(1)), "batch_mean": total / F.greatest(F.count("*"), F.lit(1))}[reduction]
    return df.withColumns({"_error": error, "_count": count}).groupBy(*(by or [])).agg(value.alias("loss"))


def masked_losses_by(df: DataFrame, by: list[str], recon: str = "x_recon", x: str = "x", masked: str = "masked") -> DataFrame:
    """The losses ``sum``, ``mean`` and ``batch_mean`` of each group of ``by`` from one aggregation."""
    error, count = row_loss(F.col(recon), F.col(x), F.col(masked))
    sums = df.withColumns({"_error": error, "_count": count}).groupBy(*by).agg(F.coalesce(F.sum("_error"), F.lit(0.0)).alias("sum"), F.sum("_count").alias("_masked"), F.count("*").alias("_rows"))
    return sums.select(*by, "sum", (F.col("sum") / F.greatest("_masked", F.lit(1))).alias("mean"), (F.col("sum") / F.col("_rows")).alias("batch_mean"))


def masked_mse(df: DataFrame, recon: str = "x_recon", x: str = "x", masked: str = "masked", reduction: str = "mean", by: list[str] | None = None) -> DataFrame:
    """``masked_sse`` that averages over masked positions by default."""
    return masked_sse(df, recon, x, masked, reduction, by)


def evaluate(df: DataFrame, loss: str = "mse", reduction: str = "mean", batch: str = "batch_id", recon: str = "x_recon", x: str = "x", masked: str = "masked") -> DataFrame:
    """The mean of the batches' losses, weighted by their rows: one row ``(loss, n_rows)``.

    A ``sum`` depends on how rows are batched, so the batch is an explicit column.
    """
    if loss not in ("mse", "sse"):
        raise ValueError(f"unknown loss {loss!r}")
    if reduction not in ("sum", "mean", "batch_mean"):
        raise ValueError(f"unknown reduction {reduction!r}")
    error, count = row_loss(F.col(recon), F.col(x), F.col(masked))
    sums = df.select(F.col(batch).alias("batch"), error.alias("error"), count.alias("count")).groupBy("batch").agg(F.sum("error").alias("s"), F.sum("count").alias("masked"), F.count("*").alias("n"))
    by = {"sum": F.lit(1), "mean": F.greatest("masked", F.lit(1)), "batch_mean": F.col("n")}[reduction]
    losses = sums.select("n", (F.coalesce("s", F.lit(0.0)) / by).alias("loss"))
    return losses.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.sum("n").alias("n_rows"))


def fixed_visible(df: DataFrame, visible: list[bool] | DataFrame, row_id: str = "row_id") -> DataFrame:
    """One visible mask for every row, or each row's own from ``(row_id, visible)``, as ``visible`` and ``masked``.

    A row that such a table has no mask for is an error when it is read; a repeated id gives the row a
    copy for each of its masks.
    """
    if isinstance(visible, DataFrame):
        own = visible.select(F.col(row_id), F.col("visible").cast("array<boolean>").alias("visible"))
        out = df.join(own, row_id, "left")
        found = F.coalesce("visible", F.raise_error(F.lit("a row has no mask")).cast("array<boolean>"))
        return out.withColumn("visible", found).withColumn("masked", F.transform("visible", lambda v: ~v))
    if not all(isinstance(v, bool) for v in visible):
        raise TypeError("the mask must be boolean")
    return df.withColumns({"visible": F.array(*map(F.lit, visible)), "masked": F.array(*[F.lit(not v) for v in visible])})
