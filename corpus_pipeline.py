"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the result is written as Parquet and
read again as the next stage's documents. Stages judge rows: null ids, repeated ids and repeated rows are allowed
everywhere, other columns are carried along, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.llm.common import ensure_checkpoint_dir, table
from spectroloom.llm.decontaminate import remove_contaminated
from spectroloom.llm.langid import fit_language_model, keep_identified
from spectroloom.llm.line_dedup import drop_boilerplate
from spectroloom.llm.minhash_dedup import keep_representatives
from spectroloom.llm.sentencepiece_codec import round_trip

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or a likely language go.

    Null, empty and letterless texts go. Languages are learned from the labelled rows of the table itself: without
    any, no language is known and every document goes. Repeated rows are judged alike and all stay or go.
    """
    return keep_identified(docs, fit_language_model(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source's distinct texts; copies are the next stage's.

    No row goes: a document of nothing but boilerplate keeps an empty text. A null source and an empty one are one,
    and a null text stays null.
    """
    return drop_boilerplate(docs, "source", copies_once=True)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words are linked with nothing, so all of them stay. Ids are what is kept: all rows of a kept id
    stay, repeated ones too, and so do rows without an id, even where their text is another document's.
    """
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows all stay or all go; an empty benchmark lets all stay.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with digests of the pieces and of the text that they decode to.

    A row for every row: null and empty texts have no pieces, repeated rows repeated results.
    """
    return round_trip(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the language model nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, by way of Parquet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
