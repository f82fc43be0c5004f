"""Encoding and decoding with a public piece vocabulary: unigram Viterbi over a double-array trie.

A text is read with a space put before it; spaces are the pieces' whitespace markers. Characters that no
piece has fall back to their bytes. Decoding joins the pieces' bytes and takes the first space off, so
every text comes back as it was. Each batch segments its distinct units once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectroloom.llm import textops as X
from spectroloom.llm.pieces import MODEL, TEXT_BYTES, TOKENIZERS, Vocabulary, load_vocabulary, units, viterbi

SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, score double, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_column(v: Vocabulary, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, first, ids, scores)`` of texts i to j - 1: pieces of text k at first[k] on, and each text's score."""
    data, offsets = X.text_buffer(column)
    for i, j in X.chunks(offsets, TEXT_BYTES):
        u = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        first, ids, score = viterbi(v, u, v.scores)
        n = np.diff(first)[u.which]
        start = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(start - first[:-1][u.which], n)
        total = np.r_[0, np.cumsum(n)]
        sums, full = np.zeros(j - i), np.flatnonzero(np.diff(u.first))
        if len(full):  # each text's own sum, whatever lies beside it
            sums[full] = np.add.reduceat(score[u.which], u.first[full])
        yield i, j, total[u.first], ids[place], sums


class Decoder:
    """The pieces' bytes, laid out for gathering."""

    def __init__(self, v: Vocabulary) -> None:
        self.size = np.array([len(p) for p in v.pieces])
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(v.pieces), np.uint8)

    def decode(self, first: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        """The texts' bytes; sequences are separated at ``first``."""
        n = self.size[ids]
        end = np.cumsum(n)
        raw = self.data[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - self.at[ids], n)].tobytes()
        bound = np.r_[0, end][first].tolist()
        for a, b in zip(bound, bound[1:]):
            yield raw[a + 1 : b]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids array<int>, score)`` of every text; null and empty texts have no pieces and the score 0.

    Rows are encoded on their own: repeated rows and null ids keep their rows. The vocabulary is read on the
    driver and sent to the tasks; its size does not depend on the data.
    """
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, first, ids, score in encode_column(v.value, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(score)], names=["doc_id", "ids", "score"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of piece ids as ``encode`` gives them; null ids decode to the empty text."""
    v = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v.value)
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            texts = [t.decode("utf-8", "replace") for t in decoder.decode(np.r_[0, np.cumsum(n)], np.asarray(lists.flatten()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZERS, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: digests of its pieces and of the decoded text, and whether that is the text.

    ``with_ids`` adds the pieces. Nulls, empty texts and repeated rows are as in ``encode``.
    """
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v.value)
        is_byte = np.zeros(len(v.value.pieces), bool)
        is_byte[v.value.byte_ids[v.value.byte_ids >= 0]] = True
        for batch in batches:
            data, offsets = X.text_buffer(batch.column(1))
            for i, j, first, ids, score in encode_column(v.value, batch.column(1)):
                n_bytes = np.diff(np.r_[0, np.cumsum(is_byte[ids])][first])
                ids_sha, text_sha, same = [], [], []
                bound = first.tolist()
                for k, got in enumerate(decoder.decode(first, ids)):
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids[bound[k] : bound[k + 1]].tolist())).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(got).hexdigest())
                    same.append(got == data[offsets[i + k] : offsets[i + k + 1]].tobytes())
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(n_bytes.astype(np.int64)), pa.array(score), pa.array(ids_sha), pa.array(text_sha), pa.array(same)]
                names = ["doc_id", "n_pieces", "n_byte_pieces", "score", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
