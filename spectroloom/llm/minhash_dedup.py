"""Near-duplicate documents by HyperMinHash over word shingles.

A document's sketch splits its shingle hashes over 128 buckets and keeps of each bucket's smallest hash the
number of leading zeros and some mantissa bits. Bands of four such registers are the candidate keys; the
collision-corrected Jaccard estimate of two sketches screens candidates, and every link is confirmed on
the full shingle sets.

Documents with equal sets are one class from the start. Of each bucket of a band, members are first
compared with its smallest member only, which joins most of a group in one linear pass. Buckets whose
members this leaves in different components are screened again by their sketches, in bounded blocks.
Components that may still be linked make a cluster, in which the members outside its largest component
are compared with all others on their full sets, block by block, until they are joined. So no candidate
link between components goes unseen, and no large group is expanded into all its pairs. A bucket's smallest
member goes to as many tasks as the bucket's size asks for, so no task gets a whole large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm import textops as X
from spectroloom.llm.blocks import block_pairs, bulk_blocks, runs
from spectroloom.llm.common import checkpointed
from spectroloom.llm.components import connected_components

#: Words of a shingle.
SHINGLE = 5
#: Similarity of a link, as a fraction of integers: 100 * |A and B| >= 75 * |A or B|.
PERCENT = 75
#: Registers of a sketch, and of a band.
REGISTERS, BAND = 128, 4
#: Bits of a register's mantissa; leading zeros have the other six.
MANTISSA = 10
#: Standard errors that an estimate may lie below the limit before a candidate is dropped unseen.
SIGMAS = 4.5
#: Members of a block when a bucket is compared within itself, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Ids that are broadcast at most to fetch their texts; more are joined.
BROADCAST_IDS = 100_000

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, j, first, hashes)``: distinct shingles of documents i to j - 1, sorted within each document."""
    for i, j, w in X.word_chunks(column, X.SPACED_WORDS, True):
        counts = w.counts()
        at = np.flatnonzero(X.gram_starts(w.first, shingle, len(w.hashes)))
        doc = np.searchsorted(w.first, at, "right") - 1
        h = X.grams(w.hashes, shingle)[at]
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        if len(short):  # fewer words: the whole sequence is the one shingle
            whole = []
            for d in short:
                own = w.hashes[w.first[d] : w.first[d + 1]]
                whole.append(X.grams(own, len(own), 5)[0])
            doc, h = np.r_[doc, short], np.r_[h, np.array(whole, np.uint64)]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)]
        doc, h = doc[new], h[new]
        yield i, j, np.searchsorted(doc, np.arange(j - i + 1)), h


def minima(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The smallest hash in each bucket, 53 bits of it, one row for each document; 1 << 53 for an empty bucket."""
    n = len(first) - 1
    least = np.full(n * REGISTERS, 1 << 53, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(least, doc * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64), h >> np.uint64(11))
    return least.reshape(n, REGISTERS)


def registers_of(least: np.ndarray) -> np.ndarray:
    """Compressed registers: 0 for an empty bucket, else leading zeros + 1 and the mantissa."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least > 0, 53 - exponent, 53)
    mantissa = np.clip((fraction - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    out = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    out[least == 1 << 53] = 0
    return out


def sketches(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Registers, one row for each document."""
    return registers_of(minima(first, h))


def band_keys(registers: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch; 0 where all its registers are empty.

    A band of a short document may have one register only, which too many others would equal by chance;
    where any is empty, the uncompressed minima count as well.
    """
    n = len(registers)
    shape = (n, REGISTERS // BAND, BAND)
    parts, whole = registers.reshape(shape).astype(np.uint64), least.reshape(shape)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64)
    sparse = ~parts.all(2)
    for k in range(BAND):
        out = X.mix(out + parts[:, :, k])
        out[sparse] = X.mix(out[sparse] + whole[:, :, k][sparse])
    out[~parts.any(2)] = 0
    return out.view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that are equal by chance in sketches of n and m shingles without a common one, about."""
    n, m = np.maximum(n, m).astype(float), np.minimum(n, m).astype(float)
    ratio = np.divide(n, m, out=np.ones_like(n), where=m > 0)
    both = REGISTERS * -np.expm1(-n / REGISTERS) * -np.expm1(-m / REGISTERS)
    # the smallest of n and of m hashes share their leading zeros with chance 0.17 if n = m, less by 4 * ratio / (1 + ratio)**2 if not, and then the mantissa with chance 2**-MANTISSA
    return both * 0.17 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of sketches, and their standard errors at the link limit."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    chance = expected_collisions(n, m)
    p = PERCENT / 100
    return np.maximum(same - chance, 0) / np.maximum(used - chance, 1), np.sqrt(p * (1 - p) / np.maximum(used, 1))


def promising(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs whose sketches and sizes allow a link."""
    value, error = estimate(a, b, n, m)
    return (value >= PERCENT / 100 - SIGMAS * error) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "k", "n", "s1", "s2", "sketch", "keys"]
    for batch in batches:
        for i, j, first, h in shingle_sets(batch.column(2)):
            total = [np.r_[np.uint64(0), np.cumsum(X.mix(h + np.uint64(k)), dtype=np.uint64)] for k in (1, 2)]
            sums = [(t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total]
            least = minima(first, h)
            rows = registers_of(least)
            keys = pa.array([r.tobytes() for r in band_keys(rows, least)], pa.binary())
            own = [batch.column(k).slice(i, j - i) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first)), *map(pa.array, sums), pa.array([r.tobytes() for r in rows], pa.binary()), keys], names=names)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64)
        row, band = np.nonzero(keys)
        own = [batch.column(k).take(pa.array(row)) for k in ("k", "id")]
        yield pa.RecordBatch.from_arrays([pa.array(keys[row, band]), *own], names=["key", "k", "id"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n, m = (np.asarray(batch.column(k)) for k in ("n_a", "n_b"))
            keep = promising(_registers(batch.column("sketch_a")), _registers(batch.column("sketch_b")), n, m)
            yield batch.filter(pa.array(keep)).select(["a", "b", "salt", "id_a", "id_b"])


class _Joined:
    """Which of the components in a task are known to be joined."""

    def __init__(self, components: np.ndarray) -> None:
        self.names, self.at = np.unique(components, return_inverse=True)
        self.root = np.arange(len(self.names))

    def roots(self) -> np.ndarray:
        """Of every row."""
        return self.root[self.at]

    def join(self, i: int, k: int) -> bool:
        """Join two rows' components; false if they were."""
        a, b = self.root[self.at[i]], self.root[self.at[k]]
        self.root[self.root == max(a, b)] = min(a, b)
        return bool(a != b)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one pair of blocks, components with a promising pair: a forest of them."""
    for run in runs(batches, ["key", "lo", "hi"]):
        comp, n, own = (run.column(k).to_numpy() for k in ("component", "n", "own"))
        if (comp == comp[0]).all():
            continue
        r, joined = _registers(run.column("sketch").combine_chunks()), _Joined(comp)
        lo, hi = np.flatnonzero(own == run.column("lo")[0].as_py()), np.flatnonzero(own == run.column("hi")[0].as_py())
        found = []
        for i in lo.tolist():
            roots = joined.roots()
            others = hi[roots[hi] != roots[i]]
            if len(others):
                for k in others[promising(r[i][None, :], r[others], n[i : i + 1], n[others])].tolist():
                    if joined.join(i, k):
                        found.append((comp[i], comp[k]))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the components of one block of a cluster that are linked on full sets: enough to join all that are."""
    for run in runs(batches, ["cluster", "target", "query"]):
        comp, asks, tells = (run.column(k).to_numpy(zero_copy_only=False) for k in ("component", "asks", "tells"))
        sets: list[np.ndarray] = []
        for i, j, first, h in shingle_sets(run.column("text").combine_chunks()):
            sets += [h[first[d] : first[d + 1]].copy() for d in range(j - i)]
        n = np.array([len(x) for x in sets])
        r = np.concatenate([sketches(np.array([0, len(x)]), x) for x in sets])
        joined, found = _Joined(comp), []
        targets = np.flatnonzero(tells)
        for i in np.flatnonzero(asks).tolist():
            roots = joined.roots()
            others = targets[roots[targets] != roots[i]]
            others = others[promising(r[i][None, :], r[others], n[i : i + 1], n[others])] if len(others) else others
            for k in others.tolist():
                if joined.root[joined.at[i]] != joined.root[joined.at[k]] and linked(sets[i], sets[k]):
                    joined.join(i, k)
                    found.append((comp[i], comp[k]))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The link rule on two full sets."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each leader, which comes before its members, on full sets."""
    group, leader, leader_id = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        a, salt, leads, ids = (batch.column(k).to_pylist() for k in ("a", "salt", "leads", "id"))
        found = []
        for i, j, first, h in shingle_sets(batch.column("text")):
            for d in range(j - i):
                own = h[first[d] : first[d + 1]]
                if leads[i + d]:
                    group, leader, leader_id = (a[i + d], salt[i + d]), own.copy(), ids[i + d]
                elif group == (a[i + d], salt[i + d]) and linked(leader, own):
                    found.append((leader_id, ids[i + d]))
        x, y = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``(k, text)`` for the distinct ``keys(k)``, once each however many rows have it; few keys are broadcast."""
    keys = checkpointed(keys)
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return rows.select("k", "text").join(keys, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))


def _links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of a leader and a member that are links on the texts of both, as document ids."""
    pairs = checkpointed(pairs)
    leaders = pairs.select("a", "salt", "id_a").distinct()
    texts = _texts(rows, leaders.select(F.col("a").alias("k")).unionAll(pairs.select(F.col("b").alias("k"))).distinct())
    members = pairs.join(texts.withColumnRenamed("k", "b"), "b").select("a", "salt", F.lit(False).alias("leads"), F.col("id_b").alias("id"), "text")
    leading = leaders.join(texts.withColumnRenamed("k", "a"), "a").select("a", "salt", F.lit(True).alias("leads"), F.col("id_a").alias("id"), "text")
    groups = members.unionAll(leading).repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("leads"))
    return groups.mapInArrow(_confirm, "a long, b long")


def _cluster_links(members: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between components of ``members(key, k, component)`` whose buckets hold several."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    members = checkpointed(members.join(mixed, "key"))
    blocks = block_pairs(members.join(classes.select("k", "n", "sketch"), "k"), "key", "k", BLOCK)
    forest = blocks.mapInArrow(_cross, "a long, b long").distinct()
    cluster = connected_components(forest).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    own = checkpointed(members.select("k", "component").distinct().join(cluster, "component"))
    own = checkpointed(own.join(_texts(rows, own.select("k")), "k").withColumn("bytes", F.octet_length("text")))
    return bulk_blocks(own, "cluster", "component", "k", BLOCK, "bytes", BLOCK_BYTES).mapInArrow(_settle, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the size of its shingle set, its component's smallest id, and whether it is that one.

    A document of fewer words than a shingle has its whole word sequence as its one shingle. Null and
    empty texts have an empty set and link with nothing. Rows with equal sets are one class, so repeated
    rows share a component; rows of one id with different texts are classes of their own that carry that
    id. A null id takes no part in links: its component is null and it is kept.
    """
    body = docs[text].cast("string")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[doc_id].cast("long"), body).alias("k"), body.alias("text"))
    signed = checkpointed(rows.mapInArrow(_sign, "doc_id long, k long, n long, s1 long, s2 long, sketch binary, keys binary"))
    full = signed.where("n > 0 and doc_id is not null")
    one = full.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "k")).alias("one"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    classes = checkpointed(one.select("s1", "s2", "n", F.col("one.doc_id").alias("id"), F.col("one.k").alias("k"), "sketch", "keys"))

    bands = classes.select("k", "id", "keys").mapInArrow(_bands, "key long, k long, id long")
    shared = bands.groupBy("key").agg(F.min(F.struct("id", "k")).alias("least"), F.count("*").alias("size")).where("size > 1")
    bands = checkpointed(bands.select("key", "k").join(shared.select("key", F.col("least.k").alias("a"), "size"), "key"))
    salts = F.ceil(F.max("size") / BLOCK).cast("int").alias("salts")
    star = bands.where("k != a").groupBy("a", F.col("k").alias("b")).agg(salts).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    leaders = bands.where("k = a").groupBy("a").agg(salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    side = {x: classes.select(F.col("k").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}
    star = star.join(side["b"], "b").join(leaders.join(side["a"], "a"), ["a", "salt"])
    screened = star.select("a", "b", "salt", "id_a", "id_b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_screen, "a long, b long, salt int, id_a long, id_b long")
    links = checkpointed(_links(screened, rows))

    component = checkpointed(connected_components(links))
    settled = classes.select("k", "id").join(component.select(F.col("node").alias("id"), "component"), "id", "left").select("k", F.coalesce("component", "id").alias("component"))
    more = checkpointed(_cluster_links(bands.select("key", "k").join(settled, "k"), classes, rows))
    component = connected_components(links.unionAll(more))

    by_class = classes.join(component.select(F.col("node").alias("id"), "component"), "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n", "s1", "s2").join(by_class, ["s1", "s2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its near duplicates; rows without an id stay.

    An id goes if none of its rows is kept.
    """
    gone = near_duplicates(docs, doc_id, text).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    gone = checkpointed(gone.select(F.col("doc_id").alias("gone_id")))
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[doc_id] == gone["gone_id"], "left_anti")
