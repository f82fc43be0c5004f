"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a text is
the sum over all its segmentations into pieces, which the forward algorithm gives unit by unit; the
language with the largest one is predicted. Piece probabilities are fitted on a bounded sample of labelled
documents by a few rounds of Viterbi counts, gathered by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.llm import textops as X
from spectroloom.llm.common import checkpointed
from spectroloom.llm.pieces import MODEL, TEXT_BYTES, TOKENIZERS, Units, Vocabulary, forward, load_vocabulary, units, viterbi

#: About how many documents of each language the model is fitted on (twice as many at most, by hash).
SAMPLE_PER_LANG = 1500
#: Rounds of Viterbi training.
ROUNDS = 2
#: Weight of the shared prior in pieces' counts.
PRIOR = 2000.0

UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def _parts(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Bounded slices of a text column, lower-cased."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    for i, j in X.chunks(np.r_[0, np.cumsum(sizes)], TEXT_BYTES):
        yield i, j, pc.utf8_lower(column.slice(i, j - i))


#: Units whose log probabilities a task keeps for later parts of its texts; others are computed again.
KEPT_UNITS = 200_000


class _Seen:
    """Log probabilities of the units that came first, by their hashes; what is not kept is computed."""

    def __init__(self, v: Vocabulary, probability: np.ndarray) -> None:
        self.v, self.probability = v, probability
        self.hashes, self.logs = np.zeros(0, np.uint64), np.zeros((0, probability.shape[1]))

    def look_up(self, u: Units) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, u.hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == u.hashes if len(self.hashes) else np.zeros(len(u.hashes), bool)
        out = np.empty((len(u.hashes), self.logs.shape[1]))
        out[known] = self.logs[at[known]]
        new = np.flatnonzero(~known)
        out[new] = forward(self.v, u.only(new), self.probability)
        new = new[: KEPT_UNITS - len(self.hashes)]
        if len(new):
            hashes = np.concatenate([self.hashes, u.hashes[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.logs = hashes[order], np.concatenate([self.logs, out[new]])[order]
        return out


class LanguageModel:
    """Languages and the probability of each piece in each."""

    def __init__(self, languages: list[str], probability: np.ndarray) -> None:
        self.languages, self.probability = languages, probability

    def log_likelihoods(self, seen: _Seen, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, j, part in _parts(column):
            u = units(*X.text_buffer(part))
            logs = seen.look_up(u)
            sums = np.zeros((j - i, len(self.languages)))
            full = np.flatnonzero(np.diff(u.first))
            if len(full):
                sums[full] = np.add.reduceat(logs[u.which], u.first[full], axis=0)
            yield i, j, sums


def _prior(v: Vocabulary) -> np.ndarray:
    p = np.exp(v.scores)
    return p / p.sum()


def fit_language_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str = TOKENIZERS, model: str = MODEL, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Fit on documents that are not held out and have a language and a text.

    Of a language with n such documents, those whose id hashes to 0 modulo n // ``sample_per_lang`` are
    taken, so the sample is bounded however large the table is. What reaches the driver is one number for
    each piece and language.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, 0)))
    every = F.create_map(*[F.lit(x) for k in languages for x in (k, max(1, sizes[k] // sample_per_lang))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.get(F.map_values(F.map_filter(every, lambda k, _: k == F.col("lang"))), F.lit(0))) == 0)
    sample = checkpointed(sample.select("lang", "text").repartition(4 * spark.sparkContext.defaultParallelism))  # bounded, and read in each round
    v = load_vocabulary(path, model)
    shared = spark.sparkContext.broadcast(v)
    prior = _prior(v)
    probability = np.repeat(prior[:, None], len(languages), 1)
    for _ in range(ROUNDS):
        with np.errstate(divide="ignore"):  # pieces that no text has
            scores = spark.sparkContext.broadcast(np.log(probability))

        def run(batches: Iterator[pa.RecordBatch], scores=scores) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(languages), len(shared.value.pieces)))
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                for k, name in enumerate(languages):
                    column = batch.column(1).take(pa.array(np.flatnonzero(names == name)))
                    for _, _, part in _parts(column):
                        u = units(*X.text_buffer(part))
                        first, ids, _ = viterbi(shared.value, u, scores.value[:, k])
                        times = np.bincount(u.which, minlength=len(u.starts))
                        counts[k] += np.bincount(ids, weights=np.repeat(times, np.diff(first)), minlength=counts.shape[1])
            at, piece = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(piece), pa.array(counts[at, piece])], names=["k", "piece", "n"])

        found = sample.mapInArrow(run, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(probability)
        counts[found["piece"], found["k"]] = found["n"]
        probability = counts + PRIOR * prior[:, None]
        probability /= probability.sum(0)
    return LanguageModel(languages, probability)


def _predictor(docs: DataFrame, model: LanguageModel, path: str, file: str):
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path, file))
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    held: list[_Seen] = []  # of a task

    def predict(column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not held:
            held.append(_Seen(v.value, fitted.value.probability))
        languages = np.array(fitted.value.languages, object)
        best, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        if len(languages):
            for i, j, sums in fitted.value.log_likelihoods(held[0], column):
                odds = np.exp(sums - sums.max(1, keepdims=True))
                own = np.array([t.is_valid and _LETTER.search(t.as_py()) is not None for t in column.slice(i, j - i)], bool)
                best[i:j][own] = languages[odds.argmax(1)][own]
                score[i:j][own] = (odds.max(1) / odds.sum(1))[own]
        return best.tolist(), score

    return predict


def predict_language(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZERS, file: str = MODEL) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row from its whole text alone.

    The score is the posterior probability with equal priors. Texts that are null or have no letter are
    ``und`` with score 0, as are all texts if there was nothing to learn from. Of equally likely languages
    the first by name is taken. Null and repeated ids keep their rows; a null id counts as the empty text
    in the fold.
    """
    predict = _predictor(docs, model, path, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.5, path: str = TOKENIZERS, file: str = MODEL) -> DataFrame:
    """The rows whose text has a language with at least ``min_score``; all their columns, whatever their names.

    Null texts and those without a letter go, as do all rows if there was nothing to learn from. Rows are
    judged on their own, so repeated rows go or stay together.
    """
    predict, place = _predictor(docs, model, path, file), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predict(batch.column(place))
            yield batch.filter(pa.array((np.array(best, object) != UNKNOWN) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)
