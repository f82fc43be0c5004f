"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spectroloom.llm import byte_bpe, sql
from spectroloom.llm.common import shared_folder, table
from spectroloom.llm.centroid_clusters import centroid_clusters
from spectroloom.llm.decontaminate import find_contamination
from spectroloom.llm.embedding_dedup import near_vectors
from spectroloom.llm.html_extract import extract_text
from spectroloom.llm.langid import fit_language_model, predict_language
from spectroloom.llm.lexical_search import ranked_search
from spectroloom.llm.license_scan import scan_licenses
from spectroloom.llm.line_dedup import line_report
from spectroloom.llm.minhash_dedup import near_duplicates
from spectroloom.llm.sentencepiece_codec import round_trip
from spectroloom.llm.sharding import assign_shards
from spectroloom.llm.substring_dedup import remove_repeats


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), map_path=shared_folder(spark, "slot-map"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, fit_language_model(docs))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_sharding": op4_sharding,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": sql.OP2,
    "op5_benchmark_decontamination": sql.OP5,
    "op8_embedding_dedup": sql.OP8,
    "op9_line_dedup": sql.OP9,
    "op10_minhash_dedup": sql.OP10,
    "op11_lexical_search": sql.OP11,
    "op12_centroid_clustering": sql.OP12,
}
