"""A public piece vocabulary as a double-array trie, and lattices of its segmentations, vectorised.

Texts are cut into units (a run of spaces and what follows up to the next space), which no piece
crosses. Units are worked on many at a time: all of them advance through the trie together, one byte a
step, and each match is an edge of its unit's lattice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from spectroloom.llm import textops as X

#: Directory of the public vocabularies; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
#: What a byte-fallback piece scores below the least score of a piece.
FALLBACK_PENALTY = 10.0
#: Bytes of text whose units are gathered at once, and of distinct units that are worked on together.
TEXT_BYTES = 1 << 19
LATTICE_BYTES = 1 << 18
#: Units above so many bytes (text without spaces) are worked on alone.
LONG_UNIT = 512
SPACE = 0x20


class DoubleArray:
    """Trie over bytes: the child of state s for byte c is base[s] + c + 1, if check there is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = v
        size = 2 * len(children) + 1024
        base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, free, top, queue = {0: 0}, 1, 1, [0]
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            while used[free]:
                free += 1
            slot = free if len(kids) < 3 else max(free, top - 2048)  # wide nodes seldom fit into the gaps far behind
            while True:
                slot = used.find(0, slot)
                at = slot - kids[0] - 1
                if at >= 0 and not any(used[at + c + 1] for c in kids):
                    break
                slot += 1
            top = max(top, at + kids[-1] + 1)
            if at + 600 > len(base):
                grow = len(base)
                base, check, out = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (out, -1)))
                used.extend(bytes(grow))
            base[place[node]] = at
            for c in kids:
                child, slot = children[node][c], at + c + 1
                used[slot], check[slot], out[slot], place[child] = 1, place[node], value[child], slot
                queue.append(child)
        self.base, self.check, self.value = base, check, out

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether there are any."""
        to = np.minimum(self.base[state] + byte.astype(np.int32) + 1, len(self.check) - 1)
        return to, self.check[to] == state


@dataclass
class Vocabulary:
    """Pieces (their space marker as a space), the trie of all but byte pieces, and Zipf's log scores by rank."""

    pieces: list[bytes]
    byte_ids: np.ndarray
    trie: DoubleArray
    scores: np.ndarray
    longest: int


def load_vocabulary(path: str = TOKENIZERS, model: str = MODEL) -> Vocabulary:
    """Read a vocabulary file on the driver.

    The file's scores are merge ranks, not log probabilities, so a piece of rank r is given Zipf's
    1 / (r + 1), normalised. Byte pieces score FALLBACK_PENALTY below the least.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{path}/{model}")
    pieces, keys, byte_ids = [], {}, np.full(256, -1, np.int64)
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            pieces.append(bytes([int(text[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            key = text.encode().replace("▁".encode(), b" ")
            if b" " in key.lstrip(b" "):
                raise ValueError(f"piece {text!r} has a space behind other characters")
            pieces.append(key)
            keys[key] = i
    ranked = sorted(keys.values(), key=lambda i: (-sp.get_score(i), i))
    p = 1.0 / np.arange(1, len(ranked) + 1)
    scores = np.full(len(pieces), -np.inf)
    scores[ranked] = np.log(p / p.sum())
    scores[byte_ids[byte_ids >= 0]] = scores[ranked].min() - FALLBACK_PENALTY
    return Vocabulary(pieces, byte_ids, DoubleArray(keys), scores, max(map(len, keys)))


@dataclass
class Units:
    """Distinct units of some texts: their bytes as rows, and which unit stands at each place."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    which: np.ndarray  # the unit at each place of the texts
    first: np.ndarray  # of n + 1: text i has places first[i] to first[i + 1] - 1
    hashes: np.ndarray  # of each unit, in rising order

    def only(self, chosen: np.ndarray) -> Units:
        """Some of the units, without places."""
        return Units(self.data, self.starts[chosen], self.ends[chosen], chosen[:0], self.first[:0], self.hashes[chosen])


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Cut texts, each with a space put before it unless it is empty."""
    n = len(offsets) - 1
    full = np.diff(offsets) > 0
    shift = np.r_[0, np.cumsum(full)]
    out = np.empty(len(data) + shift[-1], np.uint8)
    begin = offsets[:-1] + shift[:-1]
    out[begin[full]] = SPACE
    mask = np.ones(len(out), bool)
    mask[begin[full]] = False
    out[mask] = data
    space = out == SPACE
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[begin[full]] = True
    starts = np.flatnonzero(head)
    ends = np.r_[starts[1:], len(out)] if len(starts) else starts
    first = np.searchsorted(starts, np.r_[begin, len(out)])
    if not len(starts):
        return Units(out, starts, ends, starts, first, np.zeros(0, np.uint64))
    h = X.span_hashes(out, starts, ends)
    hashes, index, which = np.unique(h, return_index=True, return_inverse=True)
    return Units(out, starts[index], ends[index], which.ravel(), first, hashes)


def _rows(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(units, bytes as rows, lengths)`` of bounded sets of units of like length, but for the long ones."""
    size = u.ends - u.starts
    order = np.argsort(size, kind="stable")[: int((size <= LONG_UNIT).sum())]
    i = 0
    while i < len(order):
        j = i + 1
        longest = int(size[order[i]])
        step = max(1, LATTICE_BYTES // max(1, 2 * longest))
        j = min(len(order), i + step)
        j = max(i + 1, int(np.searchsorted(size[order], 2 * longest + 8, "right")) if size[order[j - 1]] > 2 * longest + 8 else j)
        own = order[i:j]
        length = size[own]
        width = int(length.max())
        at = u.starts[own][:, None] + np.arange(width)
        inside = np.arange(width) < length[:, None]
        yield own, np.where(inside, u.data[np.minimum(at, len(u.data) - 1)], 0), length
        i = j


_CHAR = np.ones(256, np.int64)
_CHAR[0xC0:0xE0] = 2
_CHAR[0xE0:0xF0] = 3
_CHAR[0xF0:] = 4
_CHAR[0x80:0xC0] = 0  # inside a character


def edges(v: Vocabulary, rows: np.ndarray, length: np.ndarray, reached) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(start, end, rows, pieces)`` by start: matches of the trie, and bytes of characters without a piece.

    ``reached(start)`` says for which rows a segmentation ends at ``start``.
    """
    width = rows.shape[1]
    for p in range(width):
        live = np.flatnonzero((length > p) & reached(p))
        if not len(live):
            continue
        lead = _CHAR[rows[live, p]]
        single = np.zeros(len(rows), bool)
        state, walk = np.zeros(int((lead > 0).sum()), np.int64), live[lead > 0]
        need = lead[lead > 0]
        for k in range(p, min(width, p + v.longest)):
            state, ok = v.trie.step(state, rows[walk, k])
            ok &= length[walk] > k
            state, walk, need = state[ok].astype(np.int64), walk[ok], need[ok]
            if not len(walk):
                break
            piece = v.trie.value[state]
            hit = piece >= 0
            if hit.any():
                single[walk[hit & (need == k + 1 - p)]] = True
                yield p, k + 1, walk[hit], piece[hit]
        alone = live[~single[live]]
        if len(alone):
            yield p, p + 1, alone, v.byte_ids[rows[alone, p]]


def _long_units(v: Vocabulary, u: Units) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """``(unit, bytes, edges)`` of the long units, edges by start: all starts advance through the trie together."""
    for k in np.flatnonzero(u.ends - u.starts > LONG_UNIT).tolist():
        raw = u.data[u.starts[k] : u.ends[k]]
        walk = np.flatnonzero(_CHAR[raw] > 0)
        need, state = _CHAR[raw[walk]], np.zeros(len(walk), np.int64)
        single, found = np.zeros(len(raw), bool), []
        for j in range(v.longest):
            inside = walk + j < len(raw)
            walk, need, state = walk[inside], need[inside], state[inside]
            state, ok = v.trie.step(state, raw[walk + j])
            walk, need, state = walk[ok], need[ok], state[ok].astype(np.int64)
            hit = v.trie.value[state] >= 0
            single[walk[hit & (need == j + 1)]] = True
            found.append(np.stack([walk[hit], walk[hit] + j + 1, v.trie.value[state[hit]]]))
        head = np.maximum.accumulate(np.where(_CHAR[raw] > 0, np.arange(len(raw)), 0))
        alone = np.flatnonzero(~single[head])
        found.append(np.stack([alone, alone + 1, v.byte_ids[raw[alone]]]))
        edges = np.concatenate(found, 1)
        yield k, len(raw), list(zip(*edges[:, np.argsort(edges[0], kind="stable")].tolist()))


def viterbi(v: Vocabulary, u: Units, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best segmentation of each unit: ``(first, pieces, score)``, pieces of unit i at first[i] on."""
    n = len(u.starts)
    parts, owners, total = [], [], np.zeros(n)
    for own, rows, length in _rows(u):
        m, width = rows.shape
        best = np.full((m, width + 1), -np.inf)
        back = np.zeros((m, width + 1), np.int32)
        piece = np.zeros((m, width + 1), np.int32)
        best[:, 0] = 0
        for p, e, r, ids in edges(v, rows, length, lambda p: best[:, p] > -np.inf):
            value = best[r, p] + scores[ids]
            better = value > best[r, e]
            r = r[better]
            best[r, e], back[r, e], piece[r, e] = value[better], p, ids[better]
        total[own] = best[np.arange(m), length]
        at, live = length.copy(), np.arange(m)
        while len(live):
            parts.append(piece[live, at[live]])
            owners.append(own[live])
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
    weights = scores.tolist()
    for k, size, found in _long_units(v, u):
        best, back = [-np.inf] * (size + 1), [(0, 0)] * (size + 1)
        best[0] = 0.0
        for p, e, i in found:
            value = best[p] + weights[i]
            if value > best[e]:
                best[e], back[e] = value, (p, i)
        total[k], at, ids = best[size], size, []
        while at:
            at, i = back[at]
            ids.append(i)
        parts.append(np.array(ids, np.int32))
        owners.append(np.full(len(ids), k))
    if not parts:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32), total
    owner, ids = np.concatenate(owners)[::-1], np.concatenate(parts)[::-1]
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(n + 1)), ids[order], total


def forward(v: Vocabulary, u: Units, probability: np.ndarray) -> np.ndarray:
    """Log probability of each unit under each model: the sum over all its segmentations.

    ``probability`` is (pieces, models). Columns are rescaled as they are finished, so long units do not
    underflow.
    """
    n, k = len(u.starts), probability.shape[1]
    out = np.zeros((n, k))
    for own, rows, length in _rows(u):
        m, width = rows.shape
        sums = np.zeros((m, width + 1, k))
        sums[:, 0] = 1
        scale = np.zeros(m)
        done = -1

        def reached(p: int) -> np.ndarray:
            nonlocal done
            if p > done:
                done = p
                top = sums[:, p].max(1)
                live = (top > 0) & (length > p)
                sums[live, p : p + v.longest + 1] /= top[live, None, None]
                scale[live] += np.log(top[live])
            return sums[:, p].max(1) > 0

        for p, e, r, ids in edges(v, rows, length, reached):
            sums[r, e] += sums[r, p] * probability[ids]
        with np.errstate(divide="ignore"):
            out[own] = np.log(sums[np.arange(m), length]) + scale[:, None]
    logs: list[list[float]] = []
    for unit, size, found in _long_units(v, u):
        if not logs:
            with np.errstate(divide="ignore"):
                logs = np.log(probability).T.tolist()
        for j, log_p in enumerate(logs):
            held = [-np.inf] * (size + 1)
            held[0] = 0.0
            for p, e, i in found:
                a, b = held[e], held[p] + log_p[i]
                top = max(a, b)
                held[e] = top if top == -np.inf else top + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -np.inf else top
            out[unit, j] = held[size]
    return out
