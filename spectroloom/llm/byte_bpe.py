"""Byte-level BPE: DuckDB merges the tokens of each partition's words by recursive queries.

A task cuts its texts with the vocabulary's pattern and keeps each distinct word once. The words' bytes become
(word, position) rows; each step of a recursive query joins neighbours with the merge table and contracts the
pair of least rank, leftmost first, until a word has none left. Decoding joins ids with the vocabulary and
aggregates the pieces in order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectroloom.llm.textops import release_memory

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text whose words are encoded together, and words of a long text that are cut at once.
PART_CHARS, PART_WORDS = 1 << 22, 1 << 19
#: Bytes of new words that a recursive query works on, and distinct words that a task remembers between parts.
QUERY_BYTES, KEPT_WORDS = 1 << 19, 300_000

#: One step contracts, in every unfinished word, all pairs of its least rank that do not overlap. That equals
#: contracting them one by one from the left, but where the new token may take part in a pair of lower rank
#: (``alone``): then only the leftmost goes. Only pairs of twins overlap; of a run of them every other one goes.
#: Positions leave a gap between words, so a token's end is no other word's start.
MERGE = """
WITH RECURSIVE t AS (
  SELECT word, pos, pos + 1 AS stop, id, true AS live FROM bytes
  UNION ALL
  (WITH p AS MATERIALIZED (SELECT a.word, a.pos, a.stop AS middle, b.stop, merged, alone, twin FROM t a JOIN t b ON b.pos = a.stop JOIN merges ON pair = a.id::UINTEGER * 65536::UINTEGER + b.id::UINTEGER WHERE a.live AND b.live),
   b AS MATERIALIZED (SELECT word, (k >> 32)::INT AS best, (k & 4294967295)::INT AS leftmost FROM (SELECT word, min((merged::BIGINT << 32) | pos) AS k FROM p GROUP BY word)),
   h AS MATERIALIZED (SELECT p.* FROM p JOIN b ON b.word = p.word AND best = merged AND (NOT alone OR pos = leftmost)),
   runs AS (SELECT *, pos - (middle - pos) * row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM h WHERE twin),
   c AS MATERIALIZED (SELECT pos, middle, stop, merged FROM h WHERE NOT twin UNION ALL
         SELECT pos, middle, stop, merged FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS i FROM runs) WHERE i % 2 = 1)
   SELECT t.word, t.pos, coalesce(c.stop, t.stop), coalesce(c.merged, t.id), b.word IS NOT NULL
   FROM t LEFT JOIN b ON b.word = t.word LEFT JOIN c ON c.pos = t.pos ANTI JOIN c gone ON gone.middle = t.pos WHERE t.live))
SELECT word, list(id ORDER BY pos) AS ids FROM t WHERE NOT live GROUP BY word
"""

DECODE = "SELECT text, array_to_string(list(piece ORDER BY pos), '') AS piece, bool_or(piece IS NULL) AS unknown FROM tokens LEFT JOIN vocabulary USING (id) GROUP BY text"


@dataclass
class Ranks:
    """A vocabulary by rank (which is the id), its merge table, and the pattern that cuts texts."""

    pieces: list[bytes]
    pairs: pa.Table
    pattern: str
    newer: np.ndarray  # code points


def _newer(pattern: str) -> np.ndarray:
    """Characters that ``regex`` counts as letters or numbers and the tiktoken library does not know yet."""
    import regex
    import tiktoken

    probes = [bytes([b]) for b in range(256)] + [bytes([b]) + x for b in range(0x80, 0xC0) for x in (b"a", b"1")]
    known = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(probes)}, special_tokens={})
    letter, number, out = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), []
    for c in range(0x80, 0x110000):
        ch = chr(c)
        if unicodedata.category(ch) == "Cn":
            beside = "a" if letter.match(ch) else "1" if number.match(ch) else ""
            if beside and len(known.encode_ordinary(ch + beside)) > len(ch.encode()):
                out.append(c)
    return np.array(out, np.int64)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str | None = None, pattern: str | None = None) -> Ranks:
    """Read a rank file on the driver: every split of a piece into two pieces is a merge, its rank the piece's."""
    import public_tokenizers

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) > 1 << 16 or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to at most 65535 without gaps, with every byte")
    left, right, merged, alone = [], [], [], set()
    for piece, m in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(m)
                alone |= {x for x, size in ((a, i), (b, len(piece) - i)) if size > 1 and m < x}
    a, b, m = (np.array(v, np.uint32) for v in (left, right, merged))
    pairs = pa.table({"pair": a * np.uint32(65536) + b, "merged": m.astype(np.int32), "alone": np.isin(m, sorted(alone)), "twin": a == b})
    pattern = pattern or public_tokenizers.PATTERN
    return Ranks(sorted(ranks, key=ranks.__getitem__), pairs, pattern, _newer(pattern))


class Cutter:
    """Texts into words, as the pattern of the vocabulary says."""

    def __init__(self, ranks: Ranks) -> None:
        import regex

        self.plain = self.careful = regex.compile(ranks.pattern)
        self.newer = np.zeros(0x110000, bool)
        self.newer[ranks.newer] = True
        if len(ranks.newer):
            breaks = np.flatnonzero(np.diff(ranks.newer) > 1)
            spans = zip(ranks.newer[np.r_[0, breaks + 1]].tolist(), ranks.newer[np.r_[breaks, len(ranks.newer) - 1]].tolist())
            newer = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)
            p = ranks.pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{newer}]]")
            for kind in (r" ?\p{L}+", r" ?\p{N}+"):
                p = p.replace(kind, f" ?[{kind[2:-1]}--[{newer}]]+")
            self.careful = regex.compile(f"(?V1){p}")

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's words, PART_WORDS at a time; at least one list, which may be empty."""
        careful = not text.isascii() and self.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()
        pattern = self.careful if careful else self.plain
        if len(text) <= PART_WORDS:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, PART_WORDS)):
            yield part


class Codec:
    """A task's DuckDB tables and the words that it has encoded."""

    def __init__(self, ranks: Ranks) -> None:
        import duckdb

        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET temp_directory = ''")
        n = len(ranks.pieces)
        words = pa.table({"id": np.arange(n, dtype=np.int32), "token": pa.array(ranks.pieces, pa.binary()), "piece": pa.array([p.decode("latin-1") for p in ranks.pieces])})
        for name, table in (("merges", ranks.pairs), ("vocabulary", words)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS FROM given")
        self.con.unregister("given")
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(ranks.pieces):
            if len(p) == 1:
                self.byte_id[p[0]] = i
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known, self.n, self.ids = 0, np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _query(self, sql: str, **tables: pa.Table) -> dict[str, pa.ChunkedArray]:
        for name, table in tables.items():
            self.con.register(name, table)
        out = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return {c: out.column(c) for c in out.column_names}

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(numbers of ids, ids)`` of the words: those that are pieces as they are, the others merged from bytes."""
        column = pa.array(words, pa.binary())
        n = len(words)
        direct = self._query("SELECT word, id FROM given JOIN vocabulary USING (token)", given=pa.table({"word": np.arange(n, dtype=np.int32), "token": column}))
        whole = np.asarray(direct["word"])
        rest = np.ones(n, bool)
        rest[whole] = False
        size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[: n + 1]).astype(np.int64)
        at, word = np.flatnonzero(np.repeat(rest, size)), np.repeat(np.arange(n), size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        bytes_ = pa.table({"word": word[at].astype(np.int32), "pos": (at + word[at]).astype(np.int64 if len(raw) + n >= 1 << 31 else np.int32), "id": self.byte_id[raw[at]]})
        made = self._query(MERGE, bytes=bytes_)
        owner = np.r_[whole, np.asarray(made["word"])]
        lists = made["ids"].combine_chunks()
        many = np.r_[np.ones(len(whole), np.int64), np.asarray(lists.value_lengths()).astype(np.int64)]
        flat = np.r_[np.asarray(direct["id"]), np.asarray(lists.flatten())].astype(np.int32)
        order, start = np.argsort(owner), np.cumsum(many) - many
        n_ids = many[order]
        return n_ids, flat[np.arange(n_ids.sum()) + np.repeat(start[order] - (np.cumsum(n_ids) - n_ids), n_ids)]

    def encode(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """``(first, ids)``: ids of part i at first[i] to first[i + 1] - 1."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        index = self.index
        words = pa.array([w for part in parts for w in part], pa.large_string()).dictionary_encode()
        place = np.array([index.setdefault(w, len(index)) for w in words.dictionary.to_pylist()], np.int64)
        fresh = [w.encode() for w in islice(index, self.known, None)]
        counts, found, i = [self.n], [self.ids], 0
        bounds = np.cumsum([len(w) for w in fresh])
        while i < len(fresh):
            j = max(i + 1, int(np.searchsorted(bounds, (bounds[i - 1] if i else 0) + QUERY_BYTES, "right")))
            n, ids = self._encode(fresh[i:j])
            counts.append(n)
            found.append(ids)
            i = j
        self.known, self.n, self.ids = len(index), np.concatenate(counts), np.concatenate(found)
        at = place[np.asarray(words.indices)]
        n, start = self.n[at], (np.cumsum(self.n) - self.n)[at]
        end = np.r_[0, np.cumsum(n)]
        ids = self.ids[np.arange(end[-1]) + np.repeat(start - end[:-1], n)]
        return end[np.r_[0, np.cumsum([len(part) for part in parts])].astype(np.int64)], ids

    def decode(self, first: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each sequence."""
        text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        out = [b""] * (len(first) - 1)
        got = self._query(DECODE, tokens=pa.table({"text": text, "pos": np.arange(len(ids)), "id": ids.astype(np.int32)}))
        if any(got["unknown"].to_pylist()):
            raise ValueError("ids are not all in the vocabulary")
        for i, piece in zip(got["text"].to_pylist(), got["piece"].to_pylist()):
            out[i] = piece.encode("latin-1")
        return out


def _encoded(codec: Codec, cutter: Cutter, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, first, ids)`` of parts of a column; a long text is in several parts, one after another."""
    rows, parts, size = [], [], 0
    for row in range(len(column)):
        for words in cutter.words(column[row].as_py() or ""):
            rows.append(row)
            parts.append(words)
            size += sum(map(len, words))
            if size >= PART_CHARS:
                yield np.array(rows), *codec.encode(parts)
                rows, parts, size = [], [], 0
                release_memory()
    if rows:
        yield np.array(rows), *codec.encode(parts)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text; null and empty texts have no ids.

    Rows are encoded on their own: repeated rows and null ids keep their rows, other columns are not read, and
    an empty table gives no rows. Ids are those of the tiktoken library without special tokens. The vocabulary
    is read on the driver and sent to the tasks; its size does not depend on the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cutter = Codec(ranks.value), Cutter(ranks.value)
        for batch in batches:
            held: list[np.ndarray] = []
            done = 0

            def emit(row: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([np.concatenate(held)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

            for rows, first, ids in _encoded(codec, cutter, batch.column(1)):
                for k, row in enumerate(rows.tolist()):
                    if row != done:
                        yield emit(done)
                        held, done = [], row
                    held.append(ids[first[k] : first[k + 1]])
            if held:
                yield emit(done)

    return _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, data binary)`` of ids as ``encode`` gives them: the pieces' bytes; null ids have no bytes.

    Ids that are not in the vocabulary are an error. Repeated rows and null doc ids keep their rows.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            n = np.asarray(batch.column(1).value_lengths().fill_null(0)).astype(np.int64)
            data = codec.decode(np.r_[0, np.cumsum(n)], np.asarray(batch.column(1).flatten().fill_null(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip)``: digests of each text's ids and of what they decode to.

    Ids are hashed as little-endian unsigned 32-bit integers. A long text is hashed part by part, so a task
    holds no more than a part's ids. Nulls, empty texts, repeated rows and empty tables are as in ``encode``.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cutter = Codec(ranks.value), Cutter(ranks.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            digests: list[list[str]] = [[], []]
            open_ = None

            def close() -> None:
                if open_:
                    for out, h in zip(digests, open_[1:]):
                        out.append(h.hexdigest())

            for rows, first, ids in _encoded(codec, cutter, batch.column(1)):
                decoded = codec.decode(first, ids)
                packed = ids.astype("<u4")
                for k, row in enumerate(rows.tolist()):
                    if open_ is None or row != open_[0]:
                        close()
                        open_ = (row, hashlib.sha256(), hashlib.sha256())
                    n[row] += first[k + 1] - first[k]
                    open_[1].update(packed[first[k] : first[k + 1]])
                    open_[2].update(decoded[k])
            close()
            same = [d == hashlib.sha256((t.as_py() or "").encode()).hexdigest() for d, t in zip(digests[1], batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digests[0], pa.string()), pa.array(digests[1], pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
