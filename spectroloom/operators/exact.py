"""Sums and dot products that are the same bits whatever the order and the batches.

A number is cut into limbs, integers of few bits. Sums of limbs are integers below 2**53, which doubles add
without rounding in any order, so Spark's partial aggregates merge them exactly. Dot products of limbs are exact
for the same reason, whatever the matrix library does.
"""

from __future__ import annotations

import math

import numpy as np

#: Bits of a limb, and limbs of a number up to 1 (with 54 bits below the point).
BITS, LIMBS = 18, 3
#: Rows that limbs may be summed over: a limb has up to 19 bits with its sign.
MOST_ROWS = 1 << 33


def limbs(x: np.ndarray, count: int = LIMBS, whole: int = 0) -> np.ndarray:
    """``x`` (below 2**whole in size) as ``count`` limbs along a new first axis; the rest is rounded off."""
    out = np.empty((count, *x.shape))
    rest = np.ldexp(x, BITS - whole)
    for i in range(count):
        out[i] = np.rint(rest)
        rest = np.ldexp(rest - out[i], BITS)
    return out


def value(sums: np.ndarray, whole: int = 0) -> np.ndarray:
    """The numbers whose limbs have these sums (along the first axis); each rounded once, from its exact integer."""
    total = np.zeros(sums.shape[1:], object)
    for s in sums:
        total = total * (1 << BITS) + np.array([int(v) for v in s.ravel()], object).reshape(s.shape)
    scale = 1 << (BITS * len(sums))
    flat = [int(v) * (1 << whole) / scale for v in total.ravel()]  # of two integers: correctly rounded
    return np.array(flat, float).reshape(total.shape)


def dots(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of rows with components up to 1, to about 2**-45, each from its own two rows alone."""
    bits = (52 - max(1, math.ceil(math.log2(max(u.shape[1], 1) + 1)))) // 2
    parts = []
    for x in (u, c):
        high = np.rint(np.ldexp(x, bits))
        parts.append((high, np.rint(np.ldexp(np.ldexp(x, bits) - high, bits))))
    (a, b), (p, q) = parts
    return np.ldexp((a @ p.T) + np.ldexp((a @ q.T) + (b @ p.T) + np.ldexp(b @ q.T, -bits), -bits), -2 * bits)


#: Rows whose weighted sum is exact at once, and the bits that weights and components are cut to for that.
TILE, CUT = 2048, 21
#: Bits of the lower part of a tile's sum.
LOW = 27


def weighted(g: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Limbs (4, K, D) of the sums of weights (N, K) times rows (N, D), both up to 1 in size.

    Each product is taken of both numbers cut to 42 bits, without the product of their lower halves.
    """
    out = np.zeros((4, g.shape[1], u.shape[1]))
    for i in range(0, len(g), TILE):
        cut = []
        for x in (g[i : i + TILE], u[i : i + TILE]):
            high = np.rint(np.ldexp(x, CUT))
            cut.append((high, np.rint(np.ldexp(np.ldexp(x, CUT) - high, CUT))))
        (a, b), (p, q) = cut
        for k, total in ((0, a.T @ p), (2, a.T @ q + b.T @ p)):
            top = np.floor(np.ldexp(total, -LOW))
            out[k] += top
            out[k + 1] += total - np.ldexp(top, LOW)
    return out


def weighted_value(sums: np.ndarray) -> np.ndarray:
    """The sums whose limbs ``weighted`` gives, added up over any batches."""
    exact = [[int(v) for v in s.ravel()] for s in sums]
    total = [((a << LOW) + b << CUT) + (c << LOW) + d for a, b, c, d in zip(*exact)]
    return np.array([t / (1 << 3 * CUT) for t in total], float).reshape(sums.shape[1:])
