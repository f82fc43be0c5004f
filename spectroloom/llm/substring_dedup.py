"""Exact substring removal with fixed-block anchors.

The index holds the non-overlapping blocks of ``WINDOW / 2`` words of every document; every rolling
window of that many words probes it. A repeated run of ``WINDOW`` words holds a whole block of each of
its documents, wherever it starts, so it has a hit. Hits are then extended: every WINDOW-word run
around a hit is compared by a 96-bit key with all such runs, and the ones that also start earlier make
up the maximal exact repeats whose words go.

Both exchanges carry packed arrays, one row for each input batch and hash bucket. A batch sends a hash
that it holds many times once only, so no bucket grows with the number of copies in a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm import textops as X

#: Words of a window: what repeats in so many consecutive words goes.
WINDOW = 20
#: Words that one hash bucket is meant to hold.
BUCKET_WORDS = 600_000
MIN_BUCKETS = 64
#: Bytes of text that are hashed together; equal hashes among them are sent once.
BATCH_BYTES = 8 << 20

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_PACK = "bucket int, batch long, docs binary, known binary, hashes binary, at binary, more binary"
_NO_ID = (1 << 63) - 1  # a null id sorts behind all others


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("okey"), F.xxhash64("text").alias("fp"), "text")


def _planes(values: np.ndarray, width: int) -> bytes:
    """Bytes of equal weight together, highest first: zeros and small bytes then compress."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(">u8").ravel().astype(np.uint64)


def _steps(values: np.ndarray, width: int = 8) -> bytes:
    """A sorted array as its differences."""
    return _planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)), width)


def _unsteps(raw: bytes, width: int = 8) -> np.ndarray:
    return np.cumsum(_unplanes(raw, width), dtype=np.uint64)


class _Batch:
    """One part of an Arrow batch and what it sends: a directory of its documents, and entries for the buckets.

    The name is a hash of the part's ids and texts, so that a task that runs again sends the same rows;
    this asks for input in a settled order, as files or sorted partitions give it.
    """

    def __init__(self, batch: pa.RecordBatch, i: int, first: np.ndarray) -> None:
        n = len(first) - 1
        self.start, self.first = i, first
        self.okey, self.fp = (np.asarray(batch.column(k))[i : i + n] for k in ("okey", "fp"))
        place = np.arange(1, n + 1).astype(np.uint64)
        self.name = int(X.mix(np.array([X.mix((X.mix(self.okey.astype(np.uint64)) ^ self.fp.astype(np.uint64)) + place).sum(dtype=np.uint64)]))[0] >> np.uint64(1))

    def directory(self, known: np.ndarray, n_buckets: int) -> pa.RecordBatch:
        """The documents, and word places that need no bucket's answer."""
        docs = self.okey.astype("<i8").tobytes() + self.fp.astype("<i8").tobytes() + self.first.astype("<i8").tobytes()
        return _record([self.name % n_buckets], [self.name], [docs], [_steps(np.sort(known))], [None], [None], [None])

    def entries(self, n_buckets: int, h: np.ndarray, at: np.ndarray, more: np.ndarray, bits: int, ids: bool) -> pa.RecordBatch:
        """Rows for the buckets with hashes in sorted order, at the words ``at``."""
        order = np.argsort(h)
        h, at, more = h[order], at[order], more[order]
        bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(cut)).tolist()
        spans = [slice(cut[b], cut[b + 1]) for b in full]
        used = [np.unique(np.searchsorted(self.first, at[x], "right") - 1) if ids else np.zeros(0, np.int64) for x in spans]
        dictionary = [_steps(self.first[u]) + _steps(self.okey[u]) for u in used]
        hashes = [_steps(h[x] >> np.uint64(64 - bits), bits // 8) for x in spans]
        return _record(full, [self.name] * len(full), [None] * len(full), dictionary, hashes, [_planes(at[x], 4) for x in spans], [more[x].tobytes() for x in spans])


def _record(bucket: list, batch: list, docs: list, known: list, hashes: list, at: list, more: list) -> pa.RecordBatch:
    binary = pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(batch, pa.int64()), *(pa.array(x, binary) for x in (docs, known, hashes, at, more))], names=["bucket", "batch", "docs", "known", "hashes", "at", "more"])


def _solve(choose):
    """A bucket's task: pass directories on, and send each batch the word places that ``choose`` picks."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["batch", "docs", "known", "hashes", "at", "more"]).to_pylist()
        entries = [r for r in rows if r["docs"] is None]
        out = [(r["batch"], r["docs"], r["known"]) for r in rows if r["docs"] is not None]
        if entries:
            at = [_unplanes(r["at"], 4).astype(np.int64) for r in entries]
            which = np.repeat(np.arange(len(entries)), [len(x) for x in at])
            at = np.concatenate(at)
            chosen = choose(entries, which, at)
            for k, own in zip(*_groups(which[chosen], at[chosen])):
                out.append((entries[k]["batch"], None, _steps(np.sort(own))))
        names = ["batch", "docs", "known"]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=names)

    return run


def _groups(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return keys.tolist(), np.split(value[order], first[1:])


def _by_document(table: pa.Table) -> pa.Table:
    """A batch's word places as runs (first, number) of its documents."""
    rows = table.select(["docs", "known"]).to_pylist()
    docs = next(np.frombuffer(r["docs"], "<i8") for r in rows if r["docs"] is not None)
    n = (len(docs) - 1) // 3
    okey, fp, first = docs[:n], docs[n : 2 * n], docs[2 * n :]
    at = np.unique(np.concatenate([_unsteps(r["known"]) for r in rows])).astype(np.int64)
    doc = np.searchsorted(first, at, "right") - 1
    cut = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(doc) > 0)][: len(at)])
    runs = np.stack([at[cut] - first[doc[cut]], np.diff(np.r_[cut, len(at)])], 1).astype(np.uint32)
    heads = np.flatnonzero(np.r_[True, np.diff(doc[cut]) > 0][: len(cut)])
    parts = [runs[a:b].tobytes() for a, b in zip(heads, np.r_[heads[1:], len(runs)])]
    own = doc[cut[heads]]
    return pa.table([pa.array(okey[own]), pa.array(fp[own]), pa.array(parts, pa.binary())], names=["okey", "fp", "runs"])


def _runs(packed: DataFrame, choose) -> DataFrame:
    """Runs of each document with any."""
    solved = packed.groupBy("bucket").applyInArrow(_solve(choose), "batch long, docs binary, known binary")
    return solved.groupBy("batch").applyInArrow(_by_document, "okey long, fp long, runs binary").groupBy("okey", "fp").agg(F.collect_list("runs").alias("runs"))


def _mask(parts: list[bytes], n: int, reach: int) -> np.ndarray:
    """True at every word that a run's positions, each ``reach`` words long, cover."""
    step = np.zeros(n + 1, np.int64)
    for raw in parts:
        runs = np.frombuffer(raw, np.uint32).reshape(-1, 2).astype(np.int64)
        at = np.minimum(runs[:, 0], n)
        np.add.at(step, at, 1)
        np.add.at(step, np.minimum(at + runs[:, 1] + reach - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def _spread(batch: pa.RecordBatch, n: int) -> Iterator[tuple[_Batch, np.ndarray, np.ndarray]]:
    """Bounded parts of a batch, their word hashes, and the words where an n-gram starts."""
    for i, _, w in X.word_parts(batch.column("text"), X.SPACED_WORDS, False, BATCH_BYTES):
        at = np.flatnonzero(X.gram_starts(w.first, n, len(w.hashes)))
        if len(at):
            yield _Batch(batch, i, w.first), w.hashes, at


def _probes(n_buckets: int, block: int, bits: int):
    """Rolling blocks of every batch; a hash that a batch repeats goes out once, all its places are hits already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, at in _spread(batch, block):
                h = X.grams(hashes, block)[at]
                pos = at - part.first[np.searchsorted(part.first, at, "right") - 1]
                order = np.argsort(h)
                new = np.r_[True, h[order[1:]] != h[order[:-1]]]
                heads = np.flatnonzero(new)
                again = np.diff(np.r_[heads, len(h)]) > 1
                indexed = np.logical_or.reduceat(pos[order] % block == 0, heads)
                yield part.directory(at[order[again[np.cumsum(new) - 1]]], n_buckets)
                yield part.entries(n_buckets, h[order[heads]], at[order[heads]], (indexed + 2 * again).astype(np.uint8), bits, ids=False)

    return run


def _hits(bits: int):
    def choose(entries: list[dict], which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of hashes that two batches hold, or one twice, and that some document has as a block."""
        h = np.concatenate([_unsteps(r["hashes"], bits // 8) for r in entries])
        more = np.concatenate([np.frombuffer(r["more"], np.uint8) for r in entries])
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
        count = np.diff(np.r_[heads, len(h)])
        hit = ((count > 1) | np.logical_or.reduceat(more[order] > 1, heads)) & np.logical_or.reduceat(more[order] % 2 == 1, heads)
        return order[np.repeat(hit, count)]

    return choose


def _windows(n_buckets: int, window: int, block: int):
    """Windows around the hits with 96-bit keys; of those equal in a batch only the earliest goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            for part, hashes, at in _spread(batch, window):
                first = part.first
                missed = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))) % block == 0
                for d in range(len(first) - 1):
                    if runs[part.start + d]:
                        own = slice(first[d], first[d + 1])
                        missed[own] &= ~_mask(runs[part.start + d], own.stop - own.start, 1)
                before = np.cumsum(np.r_[False, missed])
                at = at[before[at + window - block + 1] == before[at]]  # a repeated window's own blocks are all hits
                if not len(at):
                    continue
                h, g = X.grams(hashes, window, 3)[at], (X.grams(hashes, window, 4)[at] >> np.uint64(32)).astype(np.uint32)
                doc = np.searchsorted(first, at, "right") - 1
                head, later = _split(h, g, part.okey[doc], at - first[doc])
                yield part.directory(at[later], n_buckets)
                yield part.entries(n_buckets, h[head], at[head], g[head], 64, ids=True)

    return run


def _split(h: np.ndarray, g: np.ndarray, okey: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that have no earlier one with their key, and the others; entries at one place are both first."""
    order = np.lexsort((pos, okey, g, h))
    h, g, okey, pos = h[order], g[order], okey[order], pos[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = (okey == okey[head]) & (pos == pos[head])
    return order[first], order[~first]


def _repeats(entries: list[dict], which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of windows that also start earlier."""
    h = np.concatenate([_unsteps(r["hashes"]) for r in entries])
    g = np.concatenate([np.frombuffer(r["more"], np.uint32) for r in entries])
    okey, pos = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    cut = np.searchsorted(which, np.arange(len(entries) + 1))
    for k, r in enumerate(entries):
        half = len(r["known"]) // 2
        first, ids = _unsteps(r["known"][:half]).astype(np.int64), _unsteps(r["known"][half:]).astype(np.int64)
        own = slice(cut[k], cut[k + 1])
        doc = np.searchsorted(first, at[own], "right") - 1
        okey[own], pos[own] = ids[doc], at[own] - first[doc]
    return _split(h, g, okey, pos)[1]


def _kept(window: int, with_text: bool):
    """Each document's words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, n_words, n_removed, kept = batch.column("runs").to_pylist(), [], [], []
            for i, _, w in X.word_chunks(batch.column("text"), X.SPACED_WORDS, False):
                raw = w.data.tobytes()
                for d in range(len(w.first) - 1):
                    a, b = w.first[d], w.first[d + 1]
                    gone = _mask(runs[i + d] or [], b - a, window)
                    stay = np.flatnonzero(~gone)
                    text = b" ".join([raw[s:e] for s, e in zip(w.starts[a + stay].tolist(), w.ends[a + stay].tolist())])
                    n_words.append(int(b - a))
                    n_removed.append(int(gone.sum()))
                    kept.append(text.decode() if with_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: its words, how many repeat earlier text, and the text (or digest) without them.

    A word goes if a window of ``window`` words over it also starts earlier: in a document with a smaller
    id, or earlier in the same one. Windows are judged on the input. Null and empty texts have no words; a
    null id sorts last. Rows with one id are versions at one place: neither removes what both begin at
    the same word, while a later start of it in either goes; repeated rows give repeated results.
    """
    block = window // 2
    rows = _documents(docs, doc_id, text)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    n_buckets = max(MIN_BUCKETS, -(-total // BUCKET_WORDS))
    bits = min(64, max(32, 8 * -(-(total.bit_length() + 12) // 8)))  # of a probe's hash: enough that few words match by chance
    hits = _runs(rows.select("okey", "fp", "text").mapInArrow(_probes(n_buckets, block, bits), _PACK), _hits(bits))
    # both joins read all columns, so that they share one exchange of the texts
    near = rows.join(hits, ["okey", "fp"]).select("okey", "fp", "text", "runs", "doc_id").sortWithinPartitions("okey", "fp")
    gone = _runs(near.mapInArrow(_windows(max(MIN_BUCKETS, n_buckets // 8), window, block), _PACK), _repeats)
    out = rows.join(gone, ["okey", "fp"], "left").select("doc_id", "text", "runs", "okey", "fp")
    schema = SCHEMA.replace("kept_sha256", "kept_text") if with_text else SCHEMA
    return out.mapInArrow(_kept(window, with_text), schema)
