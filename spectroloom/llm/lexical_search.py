"""Ranked lexical search over an inverted index in segments: short lists term at a time, long ones document at a time.

The index is a table: each row is a segment of some megabytes of text with its documents and postings, sorted by
term. A query's short lists are summed into accumulators, which then count as one more list with a bound on what
it adds. Lists whose bounds together stay below the score that the k-th best document has so far propose no
documents; they are only looked up, by binary search, for the documents that others propose and that may still
get there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectroloom.llm import textops as X
from spectroloom.llm.common import checkpointed, shared_folder

#: Bytes of text of a segment, and (item, term) pairs that tasks are sent at once.
SEGMENT_BYTES, BLOCK_TERMS = 1 << 22, 200_000
#: Lists are short while they have, together, at most this share of the longest list, or this many postings.
SHORT_SHARE, SHORT_POSTINGS = 0.5, 64
#: Documents that are scored together before the bounds are compared again.
WINDOW = 1024
BEST = 50

_INDEX = "n_docs long, n_terms long, doc_ids binary, no_id binary, lengths binary, terms binary, counts binary, ordinals binary, tf binary"

List = tuple[np.ndarray, np.ndarray, int]  # rising documents, what each gets, the most that any gets


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the segments of all documents below ``path`` and read them again.

    Terms are the maximal runs of letters, digits and non-ASCII characters of the whole text, with A-Z
    lower-cased, and known by a 64-bit hash. Null and empty texts have no terms. Every row is a document of its
    own, repeated rows and null ids too; other columns are not read. A text longer than a segment is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _INDEX.split(", ")]
        for batch in batches:
            for i, j, w in X.word_parts(batch.column(1), X.ALNUM_WORDS, True, SEGMENT_BYTES):
                ids, n, m = batch.column(0).slice(i, j - i), w.counts(), j - i
                terms, which = np.unique(w.hashes, return_inverse=True)
                postings, tf = np.unique(which.ravel() * m + w.doc_of(), return_counts=True)
                values = [np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_null()), n.astype(np.int64), terms, np.bincount(postings // m, minlength=len(terms)).astype(np.int64), (postings % m).astype(np.int32), tf.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=names)

    spark = docs.sparkSession
    docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, _INDEX).write.parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def weight(n: int, df: int) -> int:
    """What a term of ``df`` among ``n`` documents is worth."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 for a document of mean length; exact, also where 64 bits would not do on the way."""
    if 50 * int(lengths.max(initial=0)) * n >= 1 << 63:
        return np.array([50 + 50 * v * n // total for v in lengths.tolist()], np.int64)
    return 50 + 50 * lengths * n // max(total, 1)


class Best:
    """The k best documents of an item so far; equal scores go by id, no id last."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        scores, ids, no_id = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.no_id, no_id]
        order = np.lexsort((ids, no_id, -scores))[: self.k]
        self.scores, self.ids, self.no_id = scores[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def summed(lists: list[List]) -> List:
    """Accumulators of some lists as one list: its bound is the most that any document has."""
    docs = np.concatenate([d for d, _, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], np.concatenate([s for _, s, _ in lists])[order]
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    total = np.add.reduceat(scores, first)
    return docs[first], total, int(total.max())


def hybrid(lists: list[List], n_docs: int, floor: Callable[[], int], offer: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Offer every document whose sum over the lists is at least ``floor()``, which may rise with what is offered."""
    lists = sorted(lists, key=lambda x: len(x[0]))
    size = np.cumsum([len(x[0]) for x in lists])
    n_short = int(np.searchsorted(size, max(SHORT_POSTINGS, SHORT_SHARE * len(lists[-1][0])), "right"))
    its = lists[n_short:] + ([summed(lists[:n_short])] if n_short else [])
    its.sort(key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in its])  # the most that lists 0 to i add together
    for lo in range(0, n_docs, WINDOW):
        hi, least = min(lo + WINDOW, n_docs), floor()
        first = int(np.searchsorted(reach, least, "left"))  # lists before it cannot reach the floor
        if first == len(its):
            return
        sums, seen = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
        for docs, scores, _ in its[first:]:
            a, b = np.searchsorted(docs, (lo, hi))
            sums[docs[a:b] - lo] += scores[a:b]
            seen[docs[a:b] - lo] = True
        found = np.flatnonzero(seen)
        score, found = sums[found], found + lo
        for i in range(first - 1, -1, -1):
            alive = score + reach[i] >= least
            score, found = score[alive], found[alive]
            if not len(found):
                break
            docs, scores, _ = its[i]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score = score + np.where(docs[at] == found, scores[at], 0)
        alive = score >= least
        if alive.any():
            offer(found[alive], score[alive])


def _segment(batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
    kinds = {"doc_ids": np.int64, "no_id": bool, "lengths": np.int64, "terms": np.uint64, "counts": np.int64, "ordinals": np.int32, "tf": np.int32}
    return {k: np.frombuffer(batch.column(batch.schema.get_field_index(k))[row].as_buffer(), kind) for k, kind in kinds.items()}


def _looked_up(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``terms``, and where."""
    at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
    held = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
    return held, at[held]


def _document_counts(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each of the (sorted) terms is."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                held, at = _looked_up(np.frombuffer(batch.column(0)[row].as_buffer(), np.uint64), shared.value)
                df[held] += np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)[at]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _score(index: DataFrame, wanted: np.ndarray, weights: np.ndarray, items: list[np.ndarray], floors: list[int], n: int, total: int, best: int) -> DataFrame:
    """``(item, doc_id, score)``: each task's best documents of each item, none below the item's floor."""
    shared = index.sparkSession.sparkContext.broadcast((wanted, weights, items, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, items, floors = shared.value
        tops: dict[int, Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                X.release_memory()
                s = _segment(batch, row)
                held, at = _looked_up(s["terms"], wanted)
                if not len(held):
                    continue
                count, start = s["counts"][at], (np.cumsum(s["counts"]) - s["counts"])[at]
                end = np.cumsum(count)
                where = np.arange(end[-1]) + np.repeat(start - (end - count), count)
                docs, tf = s["ordinals"][where].astype(np.int64), s["tf"][where].astype(np.int64)
                norms = length_norms(s["lengths"], n, total)
                gain = np.repeat(weights[held], count) * (1000000000 * tf // (1000 * tf + 20 * norms[docs]))
                most = np.maximum.reduceat(gain, end - count)
                lists = {t: (docs[b - c : b], gain[b - c : b], m) for t, b, c, m in zip(held.tolist(), end.tolist(), count.tolist(), most.tolist()) if m > 0}
                for i, terms in enumerate(items):
                    own = [lists[t] for t in terms.tolist() if t in lists]
                    if own:
                        top = tops.get(i)
                        if top is None:
                            top = tops[i] = Best(best, floors[i])
                        hybrid(own, len(s["lengths"]), lambda: top.floor, lambda d, v: top.offer(v, s["doc_ids"][d], s["no_id"][d]))
        for i, top in tops.items():
            m = len(top.scores)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i, np.int32)), pa.array(top.ids, mask=top.no_id), pa.array(top.scores)], names=["item", "doc_id", "score"])

    columns = ["doc_ids", "no_id", "lengths", "terms", "counts", "ordinals", "tf"]
    return index.select(*columns).mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(index: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", best: int = BEST) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents of every item, highest first, none without a score.

    Rows of one item id, null too, are one item with all their terms; an item without terms, an empty index and
    an empty table of queries give no rows. Equal scores go by rising document id, documents without an id last.
    Items are worked on in blocks of about BLOCK_TERMS terms, so what tasks are sent does not grow with their
    number. Of each block, about the square root of the segments is searched first: what an item's last ranked
    document scores there is a floor for all, so tasks send few documents that do not end up ranked.
    """
    spark, kind = index.sparkSession, queries.schema[item_id].dataType
    schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in X.word_chunks(batch.column(1), X.ALNUM_WORDS, True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(w.doc_of())), pa.array(w.hashes.view(np.int64))], names=["item_id", "term"])

    terms = queries.select(queries[item_id].alias("item_id"), queries[text].cast("string").alias("text")).mapInArrow(run, f"item_id {kind.simpleString()}, term long")
    terms = checkpointed(terms.distinct())
    n_blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    n, total, segments = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    out = spark.createDataFrame([], schema)
    for block in range(n_blocks if n else 0):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        names = list(dict.fromkeys(r["item_id"] for r in rows))
        number, own = {v: i for i, v in enumerate(names)}, [[] for _ in names]
        for r in rows:
            own[number[r["item_id"]]].append(r["term"])
        wanted = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64))
        items = [np.searchsorted(wanted, np.array(t, np.int64).view(np.uint64)).astype(np.int32) for t in own]
        weights = np.array([weight(n, df) for df in _document_counts(index, wanted).tolist()], np.int64)
        floors, stride = [1] * len(names), math.isqrt(segments)
        if stride > 1:
            some = index.where(F.pmod(F.xxhash64("doc_ids", "lengths"), F.lit(stride)) == 0)
            for r in _ranked(_score(some, wanted, weights, items, floors, n, total, best), best).where(F.col("rank") == best).collect():
                floors[r["item"]] = r["score"]
        ranked = _ranked(_score(index, wanted, weights, items, floors, n, total, best), best)
        known = spark.createDataFrame([(i, v) for i, v in enumerate(names)], f"item int, item_id {kind.simpleString()}")
        ranked = ranked.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")  # a block's items
        out = out.unionAll(checkpointed(ranked) if n_blocks > 1 else ranked)
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, best: int = BEST) -> DataFrame:
    """Index ``docs`` in the shared folder and search it for every row of ``queries``."""
    return search(build_index(docs, shared_folder(docs.sparkSession, "search-index")), queries, best=best)
