"""Random numbers as a function of (seed, row, slot), the same on any partitioning and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, row: Column, slot: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(slot) if isinstance(slot, str) else slot.cast("string")))


def uniform(h: Column, word: int = 0) -> Column:
    """[0, 1) from one of a digest's four 32-bit words."""
    return F.conv(F.substring(h, 1 + 8 * word, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(h: Column) -> Column:
    """Standard normal by Box-Muller."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(h, 0))) * F.cos(F.lit(6.283185307179586) * uniform(h, 1))


def normal_vector(seed: int | str, row: Column, size: Column) -> Column:
    """Standard normals, with one digest for each: they are made first, as each is read twice."""
    digests = F.transform(F.sequence(F.lit(0), size - 1), lambda i: digest(seed, row, i))
    return F.transform(digests, normal)
