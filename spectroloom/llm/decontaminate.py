"""Benchmark decontamination with suffix arrays over shards of the training text.

Each bounded run of documents is one shard. Its suffix array sorts all its suffixes (by words, within their
documents) by prefix doubling, as deep as the longest test item goes: no comparison with a test suffix
reads further. Every test suffix is binary-searched in every shard. The range of suffixes that begin with its
window gives all verbatim occurrences; each is then extended to its longest match, and its place is
known. A benchmark of several blocks is searched block by block in suffix arrays that are built once and
kept in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm import textops as X
from spectroloom.llm.common import checkpointed

#: Words of a window.
WINDOW = 10
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Bytes of test text that are searched at once; 8 to 12 bytes of arrays for each reach every worker.
BLOCK_BYTES = 4 << 20
#: Occurrences that are extended at once.
PART = 1 << 18

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string"
_STORED = "ids array<long>, first binary, hashes binary, suffixes binary"
_FOUND = "shard long, place int, starts binary, ends binary, names array<string>, n long, at long, item string"


class TestSet:
    """The words of a bounded block of test items, and where their windows start."""

    __test__ = False  # not a test class

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.names = [name for name, _ in items]
        parts = list(X.word_chunks(pa.array([text for _, text in items], pa.large_string()), X.ALNUM_WORDS, True))
        self.hashes = np.concatenate([w.hashes for _, _, w in parts] or [np.zeros(0, np.uint64)])
        sizes = np.concatenate([w.counts() for _, _, w in parts] or [np.zeros(0, np.int64)])
        self.first = np.r_[0, np.cumsum(sizes)]
        self.depth = int(sizes.max(initial=0))

    def item_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that hold a whole window, and its words: all of an item with fewer than ``WINDOW``."""
        at = np.arange(len(self.hashes))
        item = self.item_of(at)
        words = np.minimum(WINDOW, np.diff(self.first)[item])
        whole = at + words <= self.first[item + 1]
        return at[whole], words[whole]


def suffix_array(hashes: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` words, a document's end before any word.

    Words are ordered by their hashes. Each round multiplies the words that the order looks at, and goes on
    with those suffixes only that others still equal.
    """
    n = len(hashes)
    parts, bits = (3, 21) if n < (1 << 21) - 1 else (2, 31)
    _, rank = np.unique(hashes, return_inverse=True)
    rank = rank.ravel().astype(np.int64) + 1
    end = np.repeat(first[1:], np.diff(first))
    order, slots, open_, h = np.empty(n, np.int64), np.arange(n), np.arange(n), 1
    while len(open_):
        key, stop = rank[open_], end[open_]
        for k in range(1, parts):
            at = open_ + k * h
            key = key << bits | np.where(at < stop, rank[np.minimum(at, n - 1)], 0)
        by_key = np.argsort(key)
        key, open_ = key[by_key], open_[by_key]
        order[slots] = open_
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[open_] = head + 1  # of a group of equal suffixes, its first slot
        h *= parts
        if h >= depth:
            break
        alone = new & np.r_[new[1:], True]
        slots, open_ = slots[~alone], open_[~alone]
    return order


class _Matcher:
    """Compares suffixes of a test set with those of a shard, by hashes of word runs."""

    def __init__(self, tests: TestSet, hashes: np.ndarray, first: np.ndarray, order: np.ndarray) -> None:
        self.tests, self.hashes, self.first, self.order = tests, hashes, first, order
        self.roller = X.roller(2)
        self.test_prefix, self.prefix = self.roller.prefix(tests.hashes), self.roller.prefix(hashes)
        self.down = self.roller.down

    def common(self, s: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words the test suffixes at s and the shard's at p have in common, up to ``most``."""
        n = np.zeros(len(s), np.int64)
        a, b, down = self.test_prefix, self.prefix, self.down
        step = 1 << int(most.max(initial=1)).bit_length() - 1
        while step:
            i, k = s + n, p + n
            fits = n + step <= most
            i, k = np.where(fits, i, 0), np.where(fits, k, 0)
            width = np.where(fits, step, 0)
            same = (a[i + width] - a[i]) * down[i] == (b[k + width] - b[k]) * down[k]
            n += np.where(fits & same, step, 0)
            step >>= 1
        return n

    def left(self, p: np.ndarray) -> np.ndarray:
        """Words from p to the end of its document."""
        return self.first[np.searchsorted(self.first, p, "right")] - p

    def bound(self, s: np.ndarray, words: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of the first ``words`` of each test suffix: the slot of the first one not before, or of the first one after."""
        lo, hi = np.zeros(len(s), np.int64), np.full(len(s), len(self.order))
        test, own = self.tests.hashes, self.hashes
        for _ in range(len(self.order).bit_length()):
            mid = (lo + hi) // 2
            live = lo < hi
            p = self.order[np.minimum(mid, len(self.order) - 1)]
            most = np.minimum(words, self.left(p))
            n = self.common(s, p, most)
            whole = n == words
            beyond = ~whole & ((n == most) | (test[np.minimum(s + n, len(test) - 1)] > own[np.minimum(p + n, len(own) - 1)]))
            right = live & (beyond | (whole if after else False))
            lo, hi = np.where(right, mid + 1, lo), np.where(live & ~right, mid, hi)
        return lo

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows: test suffix, word in the shard, words of the window, words of the longest match there."""
        s, words = self.tests.windows()
        none = np.zeros(0, np.int64)
        if not len(s) or not len(self.order):
            return none, none, none, none
        low = self.bound(s, words, False)
        p = self.order[np.minimum(low, len(self.order) - 1)]
        found = (low < len(self.order)) & (self.left(p) >= words)
        found[found] = self.common(s[found], p[found], words[found]) == words[found]
        s, words, low = s[found], words[found], low[found]
        n = self.bound(s, words, True) - low
        which = np.repeat(np.arange(len(s)), n)
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        s, words, p = s[which], words[which], self.order[slot]
        rest = self.tests.first[self.tests.item_of(s) + 1] - s
        most = np.minimum(rest, self.left(p))
        longest = np.concatenate([self.common(s[i : i + PART], p[i : i + PART], most[i : i + PART]) for i in range(0, len(s), PART)] or [none])
        return s, p, words, longest


class _Hits:
    """What a block of test items hits in a shard."""

    def __init__(self, tests: TestSet, hashes: np.ndarray, first: np.ndarray, order: np.ndarray) -> None:
        self.first, self.tests = first, tests
        self.s, self.p, words, self.longest = _Matcher(tests, hashes, first, order).occurrences()
        self.doc = np.searchsorted(first, self.p, "right") - 1
        step = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(step, self.p, 1)
        np.add.at(step, self.p + words, -1)
        self.mask = np.cumsum(step[:-1]) > 0

    def items(self) -> dict[int, set[str]]:
        """Of each hit document, the names of its items."""
        out: dict[int, set[str]] = {}
        m = max(len(self.tests.names), 1)
        for pair in np.unique(self.doc * m + self.tests.item_of(self.s)).tolist():
            out.setdefault(pair // m, set()).add(self.tests.names[pair % m])
        return out

    def best(self, group: np.ndarray) -> np.ndarray:
        """The occurrence with the longest match in each group, the first in the text of equally long ones."""
        order = np.lexsort((self.s, self.p, -self.longest, group))
        g = group[order]
        return order[np.r_[True, g[1:] != g[:-1]][: len(g)]]


def _shards(column: pa.Array, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, first, hashes, suffix array)`` of bounded runs of documents."""
    for i, j, w in X.word_parts(column, X.ALNUM_WORDS, True, SHARD_BYTES):
        yield i, j, w.first, w.hashes, suffix_array(w.hashes, w.first, depth)


def _digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _rows(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, tests = _digest(set()), shared.value
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit, n_items, longest = (np.zeros(n, np.int64) for _ in range(4))
            digest, at, item = [empty] * n, [None] * n, [None] * n
            for i, j, first, hashes, order in _shards(batch.column(1), tests.depth):
                hits = _Hits(tests, hashes, first, order)
                n_words[i:j] = np.diff(first)
                n_hit[i:j] = np.diff(np.r_[0, np.cumsum(hits.mask)][first])
                for d, names in hits.items().items():
                    n_items[i + d], digest[i + d] = len(names), _digest(names)
                for k in hits.best(hits.doc).tolist():
                    d = int(hits.doc[k])
                    longest[i + d], at[i + d] = hits.longest[k], int(hits.p[k] - first[d])
                    item[i + d] = tests.names[int(tests.item_of(hits.s[k]))]
            columns = [batch.column(0), *map(pa.array, (n_words, n_hit, n_items)), pa.array(digest), pa.array(n_hit > 0), pa.array(longest), pa.array(at, pa.int64()), pa.array(item, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item"])

    return run


def _store(depth: int):
    """Shards with their suffix arrays, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, first, hashes, order in _shards(batch.column(1), depth):
                ids = pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64()))
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (first.astype("<i8"), hashes.astype("<u8"), order.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([ids, *raw], names=["ids", "first", "hashes", "suffixes"])

    return run


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    columns = [batch.column(k).to_pylist() for k in ("shard", "first", "hashes", "suffixes")]
    for shard, first, hashes, order in zip(*columns):
        yield shard, np.frombuffer(first, "<i8"), np.frombuffer(hashes, "<u8"), np.frombuffer(order, "<u4").astype(np.int64)


def _search(shared: Broadcast):
    """Of the documents that one block of test items hits: the runs of hit words, the items, and the longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            for shard, first, hashes, order in _stored(batch):
                hits = _Hits(tests, hashes, first, order)
                rows = []
                items = hits.items()
                for k in hits.best(hits.doc).tolist():
                    d = int(hits.doc[k])
                    edge = np.flatnonzero(np.diff(np.r_[0, hits.mask[first[d] : first[d + 1]].astype(np.int8), 0]))
                    rows.append((shard, d, edge[::2].astype("<i8").tobytes(), edge[1::2].astype("<i8").tobytes(), sorted(items[d]), int(hits.longest[k]), int(hits.p[k] - first[d]), tests.names[int(tests.item_of(hits.s[k]))]))
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
                columns = list(zip(*rows)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "place", "starts", "ends", "names", "n", "at", "item"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of the stored shards and their words."""
    for batch in batches:
        for shard, ids, first in zip(*(batch.column(k).to_pylist() for k in ("shard", "ids", "first"))):
            n = np.diff(np.frombuffer(first, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(n)], names=["shard", "place", "doc_id", "n_words"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words the runs of all blocks cover together."""
    for batch in batches:
        out = []
        for starts, ends in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = (np.concatenate([np.frombuffer(x, "<i8") for x in parts]) for parts in (starts, ends))
            order = np.argsort(a)
            a, b = a[order], np.maximum.accumulate(b[order])
            out.append(int(np.maximum(b - np.maximum(a, np.r_[0, b[:-1]]), 0).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["shard", "place", "n_hit"])


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The test items with the number of their block; those without an id or a text are left out."""
    items = benchmark.select(benchmark[item_id].cast("string").alias("item_id"), benchmark[text].cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _load(items: DataFrame, block: int) -> Broadcast:
    """One block of test items, sent to the executors; only one is on the driver at a time."""
    rows = items.where(F.col("block") == block).select("item_id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(TestSet(sorted(tuple(r) for r in rows)))


def _longest_item(items: DataFrame) -> int:
    """An upper bound of the words of any test item."""
    return int((items.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()[0] + 1) // 2)


def _kept_shards(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return checkpointed(rows.mapInArrow(_store(depth), _STORED).withColumn("shard", F.monotonically_increasing_id()))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, the words hit by test windows, the items they come from, and its longest verbatim match.

    A window is ``WINDOW`` consecutive words of an item, or the whole item if it has fewer. A null or
    empty text has no words and is clean. Repeated items count once by id; items without an id are left
    out; an empty test set hits nothing. Rows are judged on their own, so repeated rows repeat their
    result, and null ids are kept. ``longest_match`` counts the words of the longest match that holds a
    window (0 if none), ``longest_at`` is the first word of its first place, ``longest_item`` the first of its items by name. A
    test set above ``block_bytes`` is searched in several passes over stored suffix arrays.
    """
    items, n = _blocks(benchmark, item_id, item_text, block_bytes)
    if n == 1:
        rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
        return rows.mapInArrow(_rows(_load(items, 0)), SCHEMA)
    shards = _kept_shards(docs, doc_id, text, _longest_item(items))
    found = None
    for block in range(n):
        tests = _load(items, block)
        part = checkpointed(shards.select("shard", "first", "hashes", "suffixes").mapInArrow(_search(tests), _FOUND))
        tests.destroy()
        found = part if found is None else found.unionAll(part)
    best = F.min(F.struct((-F.col("n")).alias("less"), "at", "item")).alias("best")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    merged = found.groupBy("shard", "place").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"), names.alias("names"), best)
    covered = merged.select("shard", "place", "starts", "ends").mapInArrow(_covered, "shard long, place int, n_hit long")
    own = merged.select("shard", "place", "names", "best").join(covered, ["shard", "place"])
    sizes = shards.select("shard", "ids", "first").mapInArrow(_sizes, "shard long, place int, doc_id long, n_words long")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("names", F.array().cast("array<string>"))
    out = sizes.join(own, ["shard", "place"], "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce(-F.col("best.less"), F.lit(0)).alias("longest_match"), F.col("best.at").alias("longest_at"), F.col("best.item").alias("longest_item"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that a test window occurs in; all their columns, whatever they are.

    Null and empty texts stay, as do all rows if the test set is empty; repeated rows go or stay together.
    Of several blocks of test items, each is searched in what those before have left.
    """
    out, place = docs, docs.columns.index(text)
    items, n = _blocks(benchmark, item_id, item_text, block_bytes)
    for block in range(n):
        shared = _load(items, block)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, first, hashes, order in _shards(batch.column(place), tests.depth):
                    clean[i + _Hits(tests, hashes, first, order).doc] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
        if n > 1:  # a block's arrays go before the next one comes
            out = checkpointed(out)
            shared.destroy()
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every test suffix and its place: ``item_id, item_word, doc_id, doc_word, n_words``.

    Suffixes without a match of a whole window are not reported. Of equally long matches the one with the
    smallest ``(doc_id, doc_word)`` is kept, those of documents without an id last. Repeated rows give one
    match; of items with one id, the longest.
    """
    items, n = _blocks(benchmark, item_id, item_text, block_bytes)
    shards, out = _kept_shards(docs, doc_id, text, _longest_item(items)), None
    for block in range(n):
        tests = _load(items, block)
        part = checkpointed(shards.mapInArrow(_suffix_matches(tests), "item_id string, item_word long, doc_id long, doc_word long, n_words long"))
        tests.destroy()
        out = part if out is None else out.unionAll(part)
    best = F.max_by(F.struct("doc_id", "doc_word", "n_words"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word"))).alias("b")
    return out.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "b.*")


def _suffix_matches(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            for ids, (_, first, hashes, order) in zip(batch.column("ids").to_pylist(), _stored(batch)):
                hits = _Hits(tests, hashes, first, order)
                top = np.iinfo(np.int64).max
                by_id = np.array([top if x is None else x for x in ids], np.int64)[hits.doc]
                k = np.lexsort((hits.p - first[hits.doc], by_id, -hits.longest, hits.s))
                s = hits.s[k]
                k = k[np.r_[True, s[1:] != s[:-1]][: len(s)]]
                item = tests.item_of(hits.s[k])
                columns = ([tests.names[x] for x in item.tolist()], hits.s[k] - tests.first[item], [ids[d] for d in hits.doc[k].tolist()], hits.p[k] - first[hits.doc[k]], hits.longest[k])
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "item_word", "doc_id", "doc_word", "n_words"])

    return run
