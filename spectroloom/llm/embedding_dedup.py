"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates a vector (random signs and a fast Hadamard transform, three times) and takes the signed axis
with the largest coordinate; two of them make a table's bucket. Multiprobe puts a vector into the few
likeliest buckets of each table. Of the members of a bucket, those near the first one are a tight class:
any two of them are linked, by the triangle inequality of angles, and are counted without being
compared. All other pairs of a bucket are compared block by block: first by vectors rounded to a byte a
coordinate, whose error is bounded, so that no link is lost; the few that may be links are verified on
the whole vectors in double precision, each pair in the first bucket it shares.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectroloom.llm.blocks import bulk_blocks, runs
from spectroloom.llm.common import checkpointed
from spectroloom.llm.components import connected_components

#: Cosine of a link.
THRESHOLD = 0.9
#: Tables, hashes of a table's bucket, and buckets of each table that a vector is put into.
TABLES, HASHES, PROBES = 5, 2, 4
#: Coordinates that are tried for each hash of a probe.
CHOICES = 4
#: Members of a block.
BLOCK = 1024
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES) -> np.ndarray:
    """Buckets of unit vectors, shape (vectors, tables, probes), the likeliest first."""
    n, d = x.shape
    width = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng(SEED + d)
    choices = min(CHOICES, width)
    picks = list(itertools.product(range(choices), repeat=hashes))
    out = np.empty((n, tables, min(probes, len(picks))), np.int64)
    for t in range(tables):
        cost, code = np.zeros((n, len(picks))), np.full((n, len(picks)), t + 1, np.int64)
        for h in range(hashes):
            r = padded
            for _ in range(3):
                r = hadamard(r * rng.choice([-1.0, 1.0], width))
            size = np.abs(r)
            top = np.argsort(-size, 1, kind="stable")[:, :choices]
            value = np.take_along_axis(size, top, 1)
            axis = 2 * top + (np.take_along_axis(r, top, 1) > 0)
            at = [p[h] for p in picks]
            cost += (value[:, :1] - value)[:, at] ** 2
            code = code * (2 * width + 1) + axis[:, at]
        best = np.argsort(cost, 1, kind="stable")[:, : out.shape[2]]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out + (d << 46)  # vectors of other lengths have other buckets


def _normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors; each is brought near 1 by a power of two first, so that no square is too large or small."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    return _normal(np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64))


def rounded(u: np.ndarray) -> np.ndarray:
    """Unit vectors in a byte a coordinate, after their scale and the length of what rounding took off."""
    scale = (np.abs(u).max(1, keepdims=True) / 127).astype(np.float32)
    q = np.rint(u / scale).astype(np.int8)
    off = np.sqrt(((u - q * scale.astype(np.float64)) ** 2).sum(1, keepdims=True))
    return np.concatenate([np.hstack([scale, off.astype(np.float32)]).view(np.uint8), q.view(np.uint8)], 1)


def may_link(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rounded unit vectors, ``a`` x ``b``, can have the cosine; true of all that have it."""
    (sa, ea), (sb, eb) = (x[:, :8].copy().view(np.float32).T.astype(np.float64) for x in (a, b))
    qa, qb = (x[:, 8:].view(np.int8).astype(np.float32) for x in (a, b))
    cos = (qa * sa[:, None].astype(np.float32)) @ (qb * sb[:, None].astype(np.float32)).T
    return cos + (ea[:, None] + eb + 3 * ea[:, None] * eb) >= threshold - 1e-4  # the last for single precision


def _hash(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
            ends = np.cumsum(np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64))
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            good = [e > s and bool(np.isfinite(values[s:e]).all()) and bool(values[s:e].any()) for s, e in zip(starts, ends)]
            by_size: dict[int, list[int]] = {}
            for k in np.flatnonzero(good).tolist():
                by_size.setdefault(int(ends[k] - starts[k]), []).append(k)
            for size, rows in by_size.items():
                x = np.stack([values[starts[k] : ends[k]] for k in rows])
                unit = _normal(x)
                codes, small = bucket_codes(unit), [r.tobytes() for r in rounded(unit)]
                raw = [r.tobytes() for r in x.astype(kind)]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(raw, pa.binary()), pa.array(small, pa.binary()), pa.array(codes[:, 0, 0]), pa.array(list(codes.reshape(len(rows), -1)), pa.list_(pa.int64()))], names=["rid", "vec_id", "m", "x", "small", "main", "codes"])

    return run


def _tight(kind: str, threshold: float):
    """A vector's class: its bucket's first vector if it is within half the link angle of it, else itself."""
    near = math.sqrt((1 + threshold) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, lead_x = batch.column("x"), batch.column("lead_x")
                size, cos = np.asarray(pc.binary_length(x)), np.empty(batch.num_rows)
                for n in np.unique(size):
                    at = pa.array(np.flatnonzero(size == n))
                    cos[size == n] = (_unit(x.take(at).to_pylist(), kind) * _unit(lead_x.take(at).to_pylist(), kind)).sum(1)
                own, lead = (np.asarray(batch.column(k)) for k in ("rid", "lead_rid"))
                vec, lead_vec = (np.asarray(batch.column(k)) for k in ("vec_id", "lead_vec"))
                tight = cos >= near
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("rid", "vec_id", "m", "x", "small", "codes")), pa.array(np.where(tight, lead, own)), pa.array(np.where(tight, lead_vec, vec))], names=["rid", "vec_id", "m", "x", "small", "codes", "cls", "lead_vec"])

    return run


def _screen(threshold: float):
    """The members of one pair of blocks that may have a link there to another class, in the parts they may have it in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["bucket", "target", "query"]):
            asks, tells, bulk, cls, rid = (table.column(k).to_numpy(zero_copy_only=False) for k in ("asks", "tells", "in_bulk", "cls", "rid"))
            if not (asks.any() and tells.any()):
                continue
            small = np.stack([np.frombuffer(r, np.uint8) for r in table.column("small").to_pylist()])
            q, t = np.flatnonzero(asks), np.flatnonzero(tells)
            near = may_link(small[q], small[t], threshold) & (cls[q][:, None] != cls[t]) & (bulk[t] | (rid[q][:, None] < rid[t]))
            asks, tells = np.zeros((2, len(rid)), bool)
            asks[q], tells[t] = near.any(1), near.any(0)
            at = pa.array(np.flatnonzero(asks | tells))
            if len(at):
                names = ["bucket", "target", "query", "rid", "cls", "in_bulk"]
                out = table.select(names).take(at).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(asks).take(at), pa.array(tells).take(at)], names=[*names, "asks", "tells"])

    return run


def _verify(kind: str, threshold: float):
    """Links between classes in one pair of blocks: each vector's number, and the smallest vector it is joined to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["bucket", "target", "query"]):
            asks, tells, bulk, cls, rid, vec, m = (table.column(k).to_numpy(zero_copy_only=False) for k in ("asks", "tells", "in_bulk", "cls", "rid", "vec_id", "m"))
            x = _unit(table.column("x").to_pylist(), kind)
            codes = np.array(table.column("codes").to_pylist(), np.int64).reshape(len(x), TABLES, -1)
            bucket = table.column("bucket")[0].as_py()
            q, t = np.flatnonzero(asks), np.flatnonzero(tells)
            i, k = np.nonzero(x[q] @ x[t].T >= threshold - 1e-12)
            i, k = q[i], t[k]
            keep = (cls[i] != cls[k]) & (bulk[k] | (rid[i] < rid[k]))
            i, k = i[keep], k[keep]
            exact = np.concatenate([(x[i[s : s + 65536]] * x[k[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            i, k = i[exact >= threshold], k[exact >= threshold]
            first = np.concatenate([_first_shared(codes[i[s : s + 65536]], codes[k[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
            i, k = i[first == bucket], k[first == bucket]
            if not len(i):
                continue
            n = np.bincount(i, weights=m[k], minlength=len(x)) + np.bincount(k, weights=m[i], minlength=len(x))
            _, same = np.unique(rid, return_inverse=True)  # a vector may ask and be told
            root = _roots(same[i], same[k], same.max() + 1)
            names = np.empty(same.max() + 1, np.int64)
            names[same] = vec
            least = np.full(len(root), np.iinfo(np.int64).max)
            np.minimum.at(least, root, names)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(vec[at]), pa.array(n[at].astype(np.int64)), pa.array(least[root[same[at]]])], names=["rid", "vec_id", "n", "joined"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket, by table and number, that each two vectors have in common."""
    shared = (a[:, :, :, None] == b[:, :, None, :]).any(3)
    top = np.iinfo(np.int64).max
    by_table = np.where(shared, a, top).min(2)
    return np.take_along_axis(by_table, (by_table < top).argmax(1)[:, None], 1)[:, 0]


def _roots(i: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[k])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, k, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row: vectors within the cosine, and its component's smallest id.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do
    vectors of different lengths. Repeated rows are vectors of their own and link with each other. A null
    id takes no part in links: it has none, its component is null and it is kept.
    """
    element = vectors.schema[embedding].dataType.elementType
    kind, held = ("<f4", T.FloatType()) if isinstance(element, T.FloatType) else ("<f8", T.DoubleType())
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast(T.ArrayType(held)).alias("v"))
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("m")).select(F.xxhash64("vec_id", "v").alias("rid"), "vec_id", "v", "m")
    rows = checkpointed(rows)
    hashed = checkpointed(rows.where("vec_id is not null and v is not null").mapInArrow(_hash(kind), "rid long, vec_id long, m long, x binary, small binary, main long, codes array<long>"))

    lead = hashed.groupBy("main").agg(F.min(F.struct("vec_id", "rid", "x")).alias("lead")).select("main", F.col("lead.vec_id").alias("lead_vec"), F.col("lead.rid").alias("lead_rid"), F.col("lead.x").alias("lead_x"))
    lead = checkpointed(lead)  # both sides of the join are plain exchanges, whose large parts adaptive execution splits
    tight = hashed.join(lead, "main").mapInArrow(_tight(kind, threshold), "rid long, vec_id long, m long, x binary, small binary, codes array<long>, cls long, lead_vec long")
    tight = checkpointed(tight)

    entries = tight.select(F.explode("codes").alias("bucket"), "rid", "cls", "small")
    near = bulk_blocks(entries, "bucket", "cls", "rid", BLOCK).mapInArrow(_screen(threshold), "bucket long, target int, query int, rid long, cls long, in_bulk boolean, asks boolean, tells boolean")
    near = near.join(tight.select("rid", "vec_id", "m", "x", "codes"), "rid").repartition("bucket", "target", "query").sortWithinPartitions("bucket", "target", "query")
    found = near.mapInArrow(_verify(kind, threshold), "rid long, vec_id long, n long, joined long")
    found = checkpointed(found.groupBy("rid", "vec_id", "joined").agg(F.sum("n").alias("n")))

    edges = tight.select(F.col("vec_id").alias("a"), F.col("lead_vec").alias("b")).unionAll(found.select(F.col("vec_id").alias("a"), F.col("joined").alias("b")))
    component = connected_components(edges)
    sizes = tight.groupBy("cls").agg((F.sum("m") - 1).alias("inside"))
    across = found.groupBy("rid").agg(F.sum("n").alias("across"))
    links = tight.select("rid", "cls").join(sizes, "cls").join(across, "rid", "left").select("rid", (F.col("inside") + F.coalesce("across", F.lit(0))).alias("n_links"))
    out = rows.select("rid", "vec_id", "m").join(links, "rid", "left").join(component.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"), F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))).alias("copy")).drop("copy")
