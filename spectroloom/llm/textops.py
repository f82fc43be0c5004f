"""Vectorised tokenising and hashing of Arrow text batches with numpy.

Everything here works on the UTF-8 bytes of one Arrow batch at a time, so memory is bounded by the
batch. Words are compared by 64-bit hashes of their length and 8-byte lanes, which are mixed in pairs, pairs of
pairs and so on; a sequence of words by a polynomial over their hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that numpy works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19

_U64 = np.uint64


def _class_table(word: bytes | None, separators: bytes | None = None) -> np.ndarray:
    table = np.zeros(256, bool)
    if separators is not None:
        table[:] = True
        table[list(separators)] = False
    else:
        table[list(word)] = True
        table[0x80:] = True
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM_WORDS = _class_table(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: ``[^\x20\x09-\x0D]+``.
SPACED_WORDS = _class_table(None, b" \t\n\v\f\r")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Roller:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.up = self.down = np.ones(1, _U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.full(size, self.base, _U64)
            self.down = np.full(size, pow(self.base, -1, 1 << 64), _U64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, _U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


#: Masks of the first 0 to 8 bytes of a lane.
_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans.

    Not a polynomial: modulo 2**64 those have collisions by construction (Thue-Morse words), whatever the base.
    """
    if not len(starts):
        return np.zeros(0, _U64)
    salt = np.random.default_rng(seed).integers(1, 1 << 63, 64, dtype=np.uint64) | _U64(1)
    size = ends - starts
    n = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(n) - n
    at = np.repeat(starts - 8 * first, n) + 8 * np.arange(n.sum())
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    h = mix((lanes[at] & _LANE[np.clip(np.repeat(ends, n) - at, 0, 8)]) + salt[0])
    out = h[first]
    level, of = 1, np.flatnonzero(n > 1)
    if len(of):
        h = h[np.repeat(n > 1, n)]
    n = n[of]
    while len(of):  # halve the lanes of the spans that have more than one
        first, half = np.cumsum(n) - n, (n + 1) >> 1
        start = np.cumsum(half) - half
        left = np.arange(half.sum()) * 2 + np.repeat(first - 2 * start, half)
        paired = left + 1 < np.repeat(first + n, half)
        new = h[left]
        new[paired] = mix(mix(new[paired] + salt[level]) ^ (h[left[paired] + 1] * salt[level]))
        done = half == 1
        out[of[done]] = new[start[done]]
        h, of, n, level = new[np.repeat(~done, half)], of[~done], half[~done], level + 1
    return mix(out ^ mix(size.astype(_U64) * salt[0]))


_ROLLERS: dict[int, Roller] = {}


def roller(seed: int) -> Roller:
    if seed not in _ROLLERS:
        _ROLLERS[seed] = Roller(seed)
    return _ROLLERS[seed]


def release_memory() -> None:
    """Give the system back what earlier batches have left in this worker's allocators.

    Workers live through many stages, and an executor's memory limit counts what they hold unused.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as empty."""
    release_memory()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and each document's range in them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of n + 1: document i has words first[i] to first[i + 1] - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool, seed: int = 1) -> Words:
    """Tokenise documents that lie in ``data`` at ``offsets``."""
    if lower:
        data = LOWER[data]
    inside = kind[data]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[bounds - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, span_hashes(data, starts, ends, seed), np.searchsorted(starts, offsets))


def word_chunks(column: pa.Array, kind: np.ndarray, lower: bool, seed: int = 1, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``(i, j, words)`` of documents i to j - 1 of a string column, a bounded part at a time."""
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets, limit):
        yield i, j, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kind, lower, seed)


def word_parts(column: pa.Array, kind: np.ndarray, lower: bool, limit: int) -> Iterator[tuple[int, int, Words]]:
    """``(i, j, words)`` of parts of about ``limit`` bytes, tokenised a chunk at a time; hashes only, no bytes."""
    none = np.zeros(0, np.int64)
    begin, end, size, first, hashes = 0, 0, 0, [np.zeros(1, np.int64)], []
    for _, end, w in word_chunks(column, kind, lower):
        first.append(w.first[1:] + first[-1][-1])
        hashes.append(w.hashes)
        size += len(w.data)
        if size >= limit:
            yield begin, end, Words(none, none, none, np.concatenate(hashes), np.concatenate(first))
            begin, size, first, hashes = end, 0, [np.zeros(1, np.int64)], []
    if hashes:
        yield begin, end, Words(none, none, none, np.concatenate(hashes), np.concatenate(first))


def grams(hashes: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
    """Hashes of every ``n`` consecutive words, regardless of where documents end."""
    if len(hashes) < n:
        return np.zeros(0, _U64)
    r = roller(seed)
    p = r.prefix(hashes)
    return mix((p[n:] - p[:-n]) * r.down[: len(p) - n])


def gram_starts(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask over the first words of all n-grams: true where the n-gram lies in one document."""
    ok = np.zeros(total + 1, np.int32)
    counts = np.maximum(np.diff(first) - n + 1, 0)
    np.add.at(ok, first[:-1], counts > 0)
    np.add.at(ok, first[:-1] + counts, -(counts > 0).astype(np.int32))
    return np.cumsum(ok[:-1]).astype(bool)[: max(total - n + 1, 0)]
